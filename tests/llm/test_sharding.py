import collections
import random

import pytest
from cases import DOCS, docs, write

from tallyrock.llm import sharding


def store(spark, tmp_path, **how):
    return sharding.Store(spark, str(tmp_path / "store"), **how)


def whole(df):
    return sorted((str(tuple(r)) for r in df.drop("_shard", "_shard_bytes", "_shard_rows").collect()))


def arrive(spark, s, tmp_path, name, rows):
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / name))
    return s.append(str(tmp_path / name))


def expected_tier(size, s):
    """The tier by counting up, apart from the operator's logarithm."""
    if 2 * size >= s.target_bytes:
        return sharding.DONE
    tier, limit = 0, sharding.SMALLEST
    while size > limit:
        tier, limit = tier + 1, limit * s.fan_in
    return tier


def test_append_and_compact(spark, tmp_path):
    s = store(spark, tmp_path, arrival_bytes=20_000, target_bytes=200_000, fan_in=3)
    schema = docs(spark, clashes=True).schema
    want = []
    for k in range(7):
        part = docs(spark, [(100 * k + i, f"text {i} of {k} " * 40) for i in range(50)] + DOCS[:7], clashes=True)
        part.repartition(3).write.parquet(str(tmp_path / f"in{k}"))
        assert s.append(str(tmp_path / f"in{k}")) == k + 1
        want += whole(part)
    before = s.manifest().count()
    assert whole(s.read(schema, 7)) == sorted(want)
    version = s.compact_all(schema)
    assert version > 7 and s.manifest().count() < before
    assert whole(s.read(schema)) == sorted(want) and whole(s.read(schema, 7)) == sorted(want)
    sizes = [r.bytes for r in s.manifest().collect()]
    assert max(sizes) <= 2 * s.target_bytes and sum(r.rows for r in s.manifest().collect()) == len(want)
    assert s.compact(schema) is None


def test_many_small_arrivals_leave_few_shards(spark, tmp_path):
    """Each arrival compacted as it comes: every tier below the target holds less than fan_in shards, and tiers follow from sizes."""
    s = store(spark, tmp_path, target_bytes=40_000, fan_in=3)
    schema = docs(spark).schema
    rng, want = random.Random(4), []
    for k in range(9):
        rows = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(4000)))]
        want += rows
        arrive(spark, s, tmp_path, f"in{k}", rows)
        s.compact_all(schema)
        shards = s.manifest().collect()
        assert all(r.tier == expected_tier(r.bytes, s) for r in shards)
        count = collections.Counter(r.tier for r in shards)
        assert all(n < s.fan_in for tier, n in count.items() if tier != sharding.DONE)
    assert len(shards) <= 6 and any(r.tier > 0 or r.tier == sharding.DONE for r in shards)
    assert whole(s.read(schema)) == sorted(str(r) for r in want)


def test_merges_lessen_shards_however_a_scan_is_dealt(spark, tmp_path, monkeypatch):
    """Also where a session keeps the size of its scans' partitions whatever is asked for."""
    s = store(spark, tmp_path, target_bytes=60_000, fan_in=2)
    tight = spark.newSession()
    tight.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    tight.conf.set("spark.sql.files.openCostInBytes", "100")
    monkeypatch.setattr(s, "packing_session", lambda size: tight)
    rng, want = random.Random(6), []
    for k in range(6):
        rows = [(100 * k + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(400))) for i in range(20)]
        want += rows
        arrive(spark, s, tmp_path, f"in{k}", rows)
    s.compact_all(docs(spark).schema)
    shards = s.manifest().collect()
    assert len(shards) <= 2 and whole(s.read(docs(spark).schema)) == sorted(map(str, want))


def test_only_one_writer_commits(spark, tmp_path):
    s = store(spark, tmp_path)
    arrive(spark, s, tmp_path, "in", DOCS)
    with pytest.raises(sharding.Conflict):
        s.commit(s.manifest(), 1)
    assert s.versions() == [1] and whole(s.read(docs(spark).schema)) == whole(docs(spark))


def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path, fan_in=2), store(spark, tmp_path, fan_in=2)
    schema = docs(spark).schema
    arrive(spark, s, tmp_path, "a", [(1, "a")])
    first, name = s.write(docs(spark, [(2, "b")]))  # written, not yet committed
    arrive(spark, other, tmp_path, "c", [(3, "c")])
    other.compact_all(schema)
    other.vacuum(keep=1)
    s.change(first, name)
    assert whole(s.read(schema)) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c")]))
    # a version that comes up while a commit is prepared
    second, name = s.write(docs(spark, [(4, "d")]))
    real, times = s.commit, []

    def late(shards, version):
        if not times:
            times.append(arrive(spark, other, tmp_path, "e", [(5, "e")]))
        return real(shards, version)

    monkeypatch.setattr(s, "commit", late)
    s.change(second, name)
    assert len(s.read(schema).collect()) == 5
    # a merge of shards that another has merged is given up
    merge = s.manifest()
    merged, name = s.write(docs(spark, [(9, "of no use")]))
    other.compact_all(schema)
    with pytest.raises(sharding.Lost):
        s.change(merged, name, merge)
    assert len(s.read(schema).collect()) == 5


def test_vacuum_spares_young_kept_and_pinned(spark, tmp_path):
    s = store(spark, tmp_path, fan_in=2)
    schema = docs(spark).schema
    arrive(spark, s, tmp_path, "a", [(1, "a")])
    s.pin(1)
    for k in range(3):
        arrive(spark, s, tmp_path, f"b{k}", [(k, "b")])
        s.compact_all(schema)
    lost, name = s.write(docs(spark, [(1, "lost")]))
    s.vacuum(keep=1)  # young data stays
    s.change(lost, name)
    assert len(s.read(schema).collect()) == 5
    s.write(docs(spark, [(1, "never committed")]))
    s.vacuum(keep=2, grace=0)
    assert len(s.versions()) == 3 and len(s.read(schema, 1).collect()) == 1 and len(s.read(schema, s.versions()[-2]).collect()) == 4
    s.pin(1, False)
    s.vacuum(keep=1, grace=0)
    assert len(s.versions()) == 1 and len(s.read(schema).collect()) == 5
    gone, name = s.write(docs(spark, [(1, "x")]))
    s.vacuum(grace=0)
    with pytest.raises(sharding.Lost):
        s.change(gone, name)


def test_query(spark, tmp_path):
    got = sharding.op4_sharding(spark, write(spark, tmp_path, documents=docs(spark, clashes=True))).collect()
    assert sorted((str(r.doc_id), r.text_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in DOCS)
    assert sum({r["shard"]: r.shard_rows for r in got}.values()) == len(DOCS)


def test_empty(spark, tmp_path):
    assert sharding.op4_sharding(spark, write(spark, tmp_path, documents=docs(spark, []))).count() == 0
