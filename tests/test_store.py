"""Collections: CRUD, batches, transactions, constraints, maintenance, encryption."""

import json
import multiprocessing
import threading

import pytest
from pyspark.sql import functions as F

from sheaf import DuplicateIndexError, EncryptionError, Field, RecordNotFoundError, Schema, SchemaValidationError, Store, TransactionError
from sheaf.sources.manifest import CommitLog, DataFile, following


@pytest.fixture
def store(spark, tmp_path):
    return Store(tmp_path / "db", spark)


@pytest.fixture
def users(store):
    return store.collection("users")


def test_create_get_update_delete(users):
    made = users.create(name="ann", age=30)
    assert made == {"name": "ann", "age": 30, "id": 1}
    assert users.get(1) == made
    assert users.update(1, age=31, tags={"a": 1}) == {"name": "ann", "age": 31, "tags": {"a": 1}, "id": 1}
    assert users.update(1, tags={"b": 2})["tags"] == {"b": 2}  # shallow
    users.delete(1)
    for action in (lambda: users.get(1), lambda: users.delete(1), lambda: users.update(1, age=1)):
        with pytest.raises(RecordNotFoundError):
            action()
    assert users.create(name="bob")["id"] == 2  # ids aren't used again


def test_get_arguments(users):
    users.create(name="ann", n=18)
    assert users.get(n="18")["name"] == "ann"  # compared as strings
    for call in (lambda: users.get(), lambda: users.get(1, name="ann"), lambda: users.get(name="ann", n=1)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(RecordNotFoundError):
        users.get(name="zoe")


def test_reserved_and_unstorable_values(users):
    with pytest.raises(ValueError):
        users.create(_id=5)
    with pytest.raises(TypeError):
        users.create(x=object())
    with pytest.raises(Exception):
        users.create(x=float("nan"))
    assert users.count() == 0


def test_batches(users):
    assert [r["id"] for r in users.create_many([{"n": i} for i in range(5)])] == [1, 2, 3, 4, 5]
    assert users.update_many([1, 1, 99], n=7) == 2
    assert users.delete_many([1, 2, 2, 99]) == 2
    assert users.filter().pluck("n") == [2, 3, 4]
    assert users.count() == 3 and users.exists(n=2) and not users.exists(n=7)


def test_natural_order_and_snapshot(users):
    users.create_many([{"n": i} for i in range(3)])
    query = users.filter()
    users.update(1, n=10)
    users.create(n=99)
    assert query.pluck("n") == [0, 1, 2]  # as it was
    assert users.filter().pluck("n") == [10, 1, 2, 99]  # an update keeps its place


def test_unique(store):
    users = store.collection("u", unique_fields=["email"])
    users.create(email="a", n=1)
    users.create(n=2)
    for bad in ({"email": "a"},):
        with pytest.raises(DuplicateIndexError):
            users.create(**bad)
    users.create(email=None)
    with pytest.raises(DuplicateIndexError):
        users.create(email=None)  # nulls are values
    with pytest.raises(DuplicateIndexError):
        users.update(2, email="a")
    users.update(1, email="a", n=5)  # its own
    with pytest.raises(DuplicateIndexError):
        users.create_many([{"email": "x"}, {"email": "x"}])
    assert users.count() == 3  # the batch left nothing


def test_schema(store):
    schema = Schema(name=Field(type=str, required=True, min_length=3), age=Field(type=int, min_value=0, max_value=150), role=Field(choices=["a", "b"], default="a"), even=Field(type=int, validator=lambda v: "odd" if v % 2 else None))
    users = store.collection("s", schema=schema)
    assert users.create(name="anna", other=1)["role"] == "a"
    with pytest.raises(SchemaValidationError) as e:
        users.create(age=-1, role="z", even=3)
    assert len(e.value.errors) == 4
    with pytest.raises(SchemaValidationError):
        users.update(1, age=200)
    assert users.update(1, age=20)["age"] == 20
    assert users.create(name="bobby")["id"] == 2  # a failed validation takes no id


def test_transaction(users):
    with users.transaction() as t:
        assert "id" not in t.create(n=1)
        t.create(n=2)
        t.update(1, n=10)
        t.delete(2)
    assert users.all() == [{"n": 10, "id": 1}]
    with pytest.raises(RuntimeError), users.transaction() as t:
        t.create(n=3)
        raise RuntimeError
    with pytest.raises(RecordNotFoundError), users.transaction() as t:
        t.update(1, n=11)
        t.update(99, n=0)
    assert users.all() == [{"n": 10, "id": 1}]  # nothing of a failed commit stays
    with users.transaction() as t:
        t.commit()
    with pytest.raises(TransactionError):
        t.create(n=1)


def test_index(users):
    users.create_many([{"c": "x", "n": 1}, {"c": "y"}, {"c": "x", "n": True}])
    users.update(1, n=2)
    assert users.lookup("c", "x") == [3, 1]  # by last write
    assert users.lookup_in("c", ["y", "x"]) == [2, 3, 1]
    assert users.all_values("n") == {"2": [1], "True": [3]}
    assert users.indexed_fields() == ["c", "n"]


def test_persistence_compaction_stats(spark, tmp_path):
    with Store(tmp_path / "db", spark) as s:
        c = s.collection("c")
        c.create_many([{"n": i} for i in range(4)])
        c.update(2, n=20)
        c.delete(4)
    s = Store(tmp_path / "db", spark)
    c = s.collection("c")
    assert c.filter().pluck("n") == [0, 20, 2]
    done = c.compact()
    assert done["records_remaining"] == 3 and done["bytes_saved"] >= 0
    assert c.filter().pluck("n") == [0, 20, 2] and c.get(2)["n"] == 20
    assert c.vacuum() >= 1
    assert c.create(n=5)["id"] == 5
    stats = c.stats()
    assert stats["record_count"] == 4 and stats["last_id"] == 5 and stats["indexed_fields"] == ["n"]
    assert s.stats()["total_records"] == 4
    assert s.compact_all()["c"]["records_remaining"] == 4


def test_registry(store):
    a = store.collection("a")
    assert store.collection("a") is a
    store.collection("b")
    assert store.list_collections() == ["a", "b"]
    a.create(n=1)
    a.drop()
    assert store.list_collections() == ["b"]
    assert store.collection("a").create(n=1)["id"] == 1
    store.drop_collection("a")
    for bad in ("1x", "a-b", "", "a\n", "x" * 65):
        with pytest.raises(ValueError):
            store.collection(bad)


def test_encryption(spark, tmp_path):
    s = Store(tmp_path / "e", spark, password="pw")
    assert s.is_encrypted and "[encrypted]" in repr(s)
    c = s.collection("c")
    c.create(name="secret-name")
    c.update(1, name="other-secret")
    c.compact()
    assert b"secret" not in b"".join(p.read_bytes() for p in (tmp_path / "e").rglob("*.parquet") if p.is_file())
    again = Store(tmp_path / "e", spark, password="pw").collection("c")
    assert again.get(1)["name"] == "other-secret" and again.filter(name__contains="other").count() == 1
    with pytest.raises(EncryptionError):
        Store(tmp_path / "e", spark, password="wrong")
    with pytest.raises(EncryptionError):
        Store(tmp_path / "e", spark)
    Store(tmp_path / "p", spark)
    with pytest.raises(EncryptionError):
        Store(tmp_path / "p", spark, password="pw")
    same = s.cipher.encrypt_many(["x"] * 20)
    assert len(set(same)) == 20  # a nonce each
    with pytest.raises(EncryptionError):
        s.cipher.decrypt_str(same[0][:-4] + "AAAA")


def test_concurrent_creates(store):
    c = store.collection("c")
    store.lock_timeout = 60
    threads = [threading.Thread(target=lambda i=i: c.create(n=i)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in c.all()) == list(range(1, 13))
    assert sorted(c.filter().pluck("n")) == list(range(12))


def _publish(folder, out):
    log = CommitLog(folder)
    for _ in range(20):
        while True:
            now = log.latest()
            if log.publish(following(now, next_id=now.next_id + 1)):
                out.put(now.next_id)
                break


def test_two_processes_never_share_an_id(tmp_path):
    ctx = multiprocessing.get_context("fork")
    out = ctx.Queue()
    jobs = [ctx.Process(target=_publish, args=(tmp_path / "log", out)) for _ in range(2)]
    [j.start() for j in jobs]
    got = [out.get(timeout=60) for _ in range(40)]
    [j.join() for j in jobs]
    assert len(set(got)) == 40


def test_manifests_hold_changes(tmp_path):
    log = CommitLog(tmp_path / "log")
    files = [DataFile(f"f{i}", 1, 1, i, i) for i in range(80)]
    for i in range(80):
        now = log.latest()
        kept = now.files if i % 10 else now.files[-1:]  # now and then a compaction
        assert log.publish(following(now, files=(*kept, files[i]), next_id=i + 2))
    assert not log.publish(following(log.read(79)))
    fresh = CommitLog(tmp_path / "log")
    assert fresh.latest() == log.latest() and [f.path for f in fresh.latest().files] == ["f69", *(f"f{i}" for i in range(70, 80))]
    assert [f.path for f in fresh.read(35).files] == ["f29", *(f"f{i}" for i in range(30, 35))]
    assert fresh.forget(80) == 64 and CommitLog(tmp_path / "log").latest() == log.latest()
    assert max(p.stat().st_size for p in (tmp_path / "log").glob("*.json")) < 1500


def test_crash_before_publishing(store, monkeypatch):
    c = store.collection("c")
    c.create(n=1)
    monkeypatch.setattr(c._log, "publish", lambda m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        c.create(n=2)
    again = Store(store.path, store.spark).collection("c")
    assert again.filter().pluck("n") == [1] and again.create(n=3)["id"] == 2


def test_bulk_insert(store, spark):
    c = store.collection("c", unique_fields=["k"])
    c.create(k=-1)
    assert c.insert_df(spark.range(1000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("e")).repartition(4)) == 1000
    assert c.count() == 1001 and c.filter(e__exists=True).count() == 1000
    assert c.to_df().agg(F.min("_id"), F.max("_id"), F.countDistinct("_id")).first() == (1, 1001, 1001)
    with pytest.raises(DuplicateIndexError):
        c.insert_df(spark.range(5).select(F.col("id").alias("k")))
    assert c.create(k=5000)["id"] == 1002


def test_bulk_insert_keeps_the_schema(store, spark):
    schema = Schema(name=Field(type=str, required=True), age=Field(type=int, min_value=0), role=Field(default="user"), tags=Field(type=list, default=[]), extra=Field(type=dict, default={"a": [1]}))
    c = store.collection("c", schema=schema)
    for frame, errors in (
        (spark.createDataFrame([("x",)], "age string"), ["required", "type"]),
        (spark.createDataFrame([(None, 3)], "name string, age int"), ["required"]),
        (spark.createDataFrame([("a", -3)], "name string, age int"), ["min"]),
        (spark.createDataFrame([("a", "b")], "name string, tags string"), ["type"]),
    ):
        with pytest.raises(SchemaValidationError) as e:
            c.insert_df(frame)
        assert sorted(e.value.errors) == errors and c.count() == 0
    c.insert_df(spark.createDataFrame([("ann", None, None), ("bob", 4, ["x"])], "name string, age int, tags array<string>"))
    assert c.all() == [{"name": "ann", "age": None, "role": "user", "tags": [], "extra": {"a": [1]}, "id": 1}, {"name": "bob", "age": 4, "role": "user", "tags": ["x"], "extra": {"a": [1]}, "id": 2}]
    assert c.create(name="cid") == {"name": "cid", "role": "user", "tags": [], "extra": {"a": [1]}, "id": 3}


def test_bulk_update_and_delete(store, spark):
    c = store.collection("c", unique_fields=["u"])
    c.insert_df(spark.range(100).select(F.col("id").alias("n"), F.col("id").alias("u"), F.lit("old").alias("s")).repartition(3))
    before = c.filter().pluck("n")
    ids = spark.createDataFrame([(5,), (6,), (6,), (500,), (None,)], "i long")
    assert c.update_df(ids, s="new", t={"x": [1, None]}) == 2
    assert c.get(5)["s"] == "new" and c.get(6)["t"] == {"x": [1, None]} and c.filter(s="new").count() == 2
    assert c.filter().pluck("n") == before  # updates keep their places
    with pytest.raises(DuplicateIndexError):
        c.update_df(ids, u=1000)
    taken = c.get(9)["u"]
    with pytest.raises(DuplicateIndexError):
        c.update_df(spark.createDataFrame([(5,)], "i long"), u=taken)
    assert c.update_df(spark.createDataFrame([(5,)], "i long"), u=1000) == 1 and c.get(5)["u"] == 1000
    assert c.delete_df(ids) == 2 and c.delete_df(ids) == 0 and c.update_df(ids, s="x") == 0
    assert c.count() == 98 and c.create(n=1)["id"] == 101
    with pytest.raises(ValueError):
        c.update_df(ids, _id=3)


def test_bulk_update_of_encrypted_documents(spark, tmp_path):
    c = Store(tmp_path / "e", spark, password="pw").collection("c")
    c.insert_df(spark.range(3).select(F.col("id").alias("n")))
    assert c.update_df(spark.createDataFrame([(2,)], "i long"), s="secret-word") == 1 and c.get(2) == {"n": 1, "s": "secret-word", "id": 2}
    assert b"secret-word" not in b"".join(p.read_bytes() for p in (tmp_path / "e").rglob("*.parquet") if p.is_file())


def test_many_updates_at_once(users):
    users.create_many([{"n": i} for i in range(60)])
    assert users.update_many([*range(1, 51), 1, 99], n=7) == 51 and users.filter(n=7).count() == 50
    assert users.delete_many(range(1, 41)) == 40 and users.count() == 20


def test_cache_survives_own_writes(users):
    users.create_many([{"n": i} for i in range(3)])
    users.get(1), users.get(2)
    users.update(1, n=10)
    hits = users.stats()["cache"]["hits"]
    assert users.get(2)["n"] == 1 and users.stats()["cache"]["hits"] == hits + 1
    assert users.get(1)["n"] == 10


def test_vacuum_spares_running_writers(users):
    users.create(n=1)
    running = users.path / "data" / "0123.parquet"
    running.write_bytes(b"not published yet")
    assert [e["file"] for e in users.pending_entries()] == ["0123.parquet"] and list(users._store.all_pending()) == ["users"]
    users.compact()
    assert users.vacuum() == 1 and running.exists()
    assert users.vacuum(retention=-1) == 1 and not running.exists() and users.count() == 1
    assert users._store.all_pending() == {}


def test_collections_of_two_stores(spark, tmp_path):
    one, two = Store(tmp_path / "db", spark), Store(tmp_path / "db", spark)
    one.collection("a"), two.collection("b")
    assert one.list_collections() == two.list_collections() == ["a", "b"]


def test_jsonl_in_splits(store, spark, tmp_path):
    """Lines keep their order across splits and files."""
    (tmp_path / "logs").mkdir()
    for f in range(2):
        lines = [json.dumps({"_id": k % 50, "_created": 1, "_updated": 1, "_deleted": False, "v": [f, k], "pad": "x" * 200}) for k in range(3000)]
        (tmp_path / "logs" / f"{f}.data").write_text("\r\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        c = store.collection("c")
        assert c.import_jsonl(str(tmp_path / "logs")) == 50
        assert {r["id"]: r["v"] for r in c.all()} == {k: [1, 2950 + k] for k in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jsonl_exchange(store, spark, tmp_path):
    lines = [
        {"_id": 2, "_created": 5, "_updated": 5, "_deleted": False, "v": "a"},
        {"_id": 1, "_created": 5, "_updated": 5, "_deleted": False, "v": "b", "w": None},
        {"_id": 2, "_created": 5, "_updated": 6, "_deleted": False, "v": "c"},
        {"_id": 3, "_created": 5, "_updated": 5, "_deleted": False, "v": "d"},
        {"_id": 3, "_created": 5, "_updated": 7, "_deleted": True, "v": "d"},
    ]
    text = "\n".join(map(json.dumps, lines)) + '\n\n{"torn": \nnot json\n'
    (tmp_path / "old.data").write_text(text)
    c = store.collection("c")
    with pytest.warns(RuntimeWarning):
        c.import_jsonl(str(tmp_path / "old.data"))
    assert c.all() == [{"v": "c", "id": 2}, {"v": "b", "w": None, "id": 1}]
    assert c.create(v="e")["id"] == 4
    c.export_jsonl(str(tmp_path / "out"))
    back = store.collection("back")
    back.import_jsonl(str(tmp_path / "out"))
    assert back.all() == c.all()


def test_change_stream(store, spark):
    from sheaf.streaming.tail import changes

    c = store.collection("c")
    c.create_many([{"n": i} for i in range(3)])
    c.delete(1)
    stream = changes(c).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("tailed").count() == 4
