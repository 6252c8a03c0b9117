import hashlib

from tsfoundry.llm.sharding import NAME, SHARD_BYTES, query, shard


def brute(rows, limit):
    """Split buckets of (bits, bytes) until they fit; depth by bits."""
    out, open_ = {}, [("", rows)]
    while open_:
        prefix, own = open_.pop()
        if sum(n for _, n in own) > limit and len({b for b, _ in own}) > 1:
            for bit in "01":
                open_.append((prefix + bit, [r for r in own if r[0].startswith(prefix + bit)]))
        else:
            out |= {b: prefix for b, _ in own}
    return out


def bits_of(spark, docs):
    rows = docs.selectExpr("doc_id", "substr(lpad(bin(xxhash64(doc_id, text)), 64, '0'), 1, 60) AS bits", "coalesce(octet_length(text), 0) AS n")
    return {r.doc_id: (r.bits, r.n) for r in rows.collect()}


def check(spark, docs, limit):
    known = bits_of(spark, docs)
    want = brute(list(known.values()), limit)
    got = shard(docs, limit=limit).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.shard == want[known[r.doc_id][0]]
        assert r.depth == len(r.shard) and r.n_bytes == known[r.doc_id][1]
    return got


def test_splits_like_brute_force(spark):
    rows = [(i, hashlib.sha256(str(i % 7).encode()).hexdigest() * (1 + i % 40)) for i in range(900)]
    assert len({r.shard for r in check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 50_000)}) > 8


def test_long_texts_in_one_cell_go_below_it(spark):
    rows = [(i, "x" * 600) for i in range(300)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 700)


def test_text_over_the_limit_stays_whole(spark):
    rows = [(1, "x" * 10_000), (2, "y"), (3, None), (4, ""), (None, None)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100)


def test_copies_split_and_names_may_clash(spark):
    """Copies of one row spread over shards like other rows; so do texts with equal ids."""
    rows = [(5, "z" * 90, 1, "a", 3)] * 60 + [(6, "z" * 90, 2, "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell int, bits string, copy int")
    got = shard(docs, limit=200).collect()
    assert sorted(r.doc_id for r in got) == [5] * 60 + [6]
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert max(size.values()) <= 200


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_fits_the_limit(spark):
    rows = query(spark, "/root/testdata/sf0.001").groupBy("shard").sum("n_bytes").collect()
    assert NAME == "op6_sharding" and all(r[1] <= SHARD_BYTES for r in rows)


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(1000, "y" * 900), (1000, "y" * 900), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shard(df, limit=700).collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        size.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(x) <= 700 or max(x) == 900 for x in size.values())
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert shard(df.where("false")).count() == 0
