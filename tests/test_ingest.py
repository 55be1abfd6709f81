"""Raw ingestion of files that differ in columns and types, and of files that can't be read."""

import pytest

from martlake.sources import store as st
from martlake.streaming import ingest as ing
from martlake.streaming.schema_log import Column, SchemaLog


@pytest.fixture
def land(spark, tmp_path):
    """Writes a file of payments, ingests what's new, gives the raw table."""
    store = st.Store(spark, str(tmp_path / "s"))
    table = store.table("bronze", "payments_raw")

    class Land:
        root, raw, state = str(tmp_path / "land"), table, str(tmp_path / "state")
        rejected = store.table("bronze", "payments_raw_rejected")

        def write(self, batch, *rows, columns):
            ing.exact_names(spark).createDataFrame(list(rows), columns).coalesce(1).write.mode("append").parquet(f"{self.root}/payments/{batch}")

        def ingest(self, run="run", **kw):
            return ing.ingest(spark, self.root, "payments", table, self.state, run, **kw)

    return Land()


def test_mixed_types_in_one_micro_batch(spark, land):
    land.write("batch_000", ("p1", "10.50", "paid"), columns="payment_id string, amount string, payment_status string")
    land.write("batch_001", (2, 7, None), columns="payment_id int, amount int, payment_status string")
    assert land.ingest() == 2
    land.write("batch_002", ("p3", 1.25), columns="payment_id string, amount double")
    assert land.ingest("run2") == 3
    rows = {r.payment_id: (r.amount, r.payment_status, r._batch_id, r._pipeline_run_id, r._rescued_data) for r in land.raw.read().collect()}
    assert rows == {"p1": ("10.50", "paid", "batch_000", "run", None), "2": ("7", None, "batch_001", "run", None), "p3": ("1.25", None, "batch_002", "run2", None)}
    assert not land.rejected.exists()


def test_new_columns_become_columns(spark, land):
    land.write("batch_000", ("p1", "1"), columns="payment_id string, amount string")
    land.ingest("run0", evolve=True)
    before = land.raw.schema().names
    land.write("batch_001", ("p2", 3, [1, 2]), columns="payment_id string, fee int, parts array<int>")
    land.write("batch_002", ("p3", "x", ("a", 1), "u"), columns="payment_id string, fee string, shop struct<name string, n int>, FEE string")
    land.ingest("run1", evolve=True)
    land.write("batch_003", ("p4", "kept", "mine"), columns="Payment_ID string, _batch_id string, _source_file string")
    land.ingest("run2", evolve=True)
    rows = {r.payment_id: r for r in land.raw.read().collect()}
    assert land.raw.schema().names == [*before, "fee", "parts", "shop"]
    assert (rows["p1"].fee, rows["p2"].fee, rows["p2"].parts, rows["p3"].fee, rows["p3"].shop, rows["p3"].parts) == (None, "3", "[1,2]", "x", '{"name":"a","n":1}', None)
    assert rows["p3"]._rescued_data == '{"FEE":"u"}'  # it differs from fee in case alone
    assert rows[None]._rescued_data == '{"Payment_ID":"p4","_batch_id":"kept","_source_file":"mine"}' and rows[None]._batch_id == "batch_003"
    log = SchemaLog(spark, f"{land.state}/_schemas/payments")
    assert log.versions() == [0] and log.columns() == [Column("fee", "int", "run1"), Column("parts", "array<int>", "run1"), Column("shop", "struct<name:string,n:int>", "run1")]


def test_without_evolving_new_columns_are_rescued(spark, land):
    land.write("batch_000", ("p1", 3), columns="payment_id string, fee int")
    land.write("batch_001", ("p2", None), columns="payment_id string, fee string")
    land.ingest()
    assert {r.payment_id: r._rescued_data for r in land.raw.read().collect()} == {"p1": '{"fee":"3"}', "p2": None}
    assert "fee" not in land.raw.schema().names


def test_unreadable_files_are_set_aside(spark, land, tmp_path):
    for k in range(4):
        land.write(f"batch_00{k}", *((f"p{k}-{i}", str(i)) for i in range(50)), columns="payment_id string, amount string")
    folder = tmp_path / "land/payments"
    (folder / "batch_000/broken.parquet").write_bytes(b"this is no Parquet file")
    (folder / "batch_000/empty.parquet").write_bytes(b"")  # not even listed
    whole = next((folder / "batch_002").glob("part*"))
    data = bytearray(whole.read_bytes())
    data[4:60] = b"\xff" * 56  # its footer is whole, its pages aren't
    whole.write_bytes(data)
    for crc in folder.rglob(".*.crc"):
        crc.unlink()
    assert land.ingest() == 150
    aside = {r.file.rsplit("/", 2)[-2] + "/" + r.file.rsplit("/", 1)[-1]: r for r in land.rejected.read().collect()}
    assert set(aside) == {"batch_000/broken.parquet", f"batch_002/{whole.name}"}
    assert all(r.reason and r._pipeline_run_id == "run" for r in aside.values())
    land.write("batch_009", ("q", "1"), columns="payment_id string, amount string")
    assert land.ingest("run2") == 151 and land.rejected.read().count() == 2


def test_errors_that_no_file_causes_are_raised(spark, land, monkeypatch):
    land.write("batch_000", ("p1", "1"), columns="payment_id string, amount string")
    monkeypatch.setattr(land.raw, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(Exception, match="no space"):
        land.ingest()
    monkeypatch.undo()
    assert land.ingest() == 1  # the batch is tried again


def test_schema_log(spark, tmp_path, monkeypatch):
    log = SchemaLog(spark, str(tmp_path / "log"))
    assert log.columns() == [] and log.versions() == []
    a, b, c = Column("a", "int", "r"), Column("b", "string", "r"), Column("a", "string", "s")
    assert log.evolve([a, c]) == [a] and log.evolve([c]) == [a]
    assert log.evolve([b, a]) == [a, b] and log.versions() == [0, 1] and log.columns(0) == [a]
    with pytest.raises(LookupError):
        log.columns(7)
    # another writer makes the version that this one is about to make
    other, real, once = SchemaLog(spark, log.path), log.versions, []

    def late():
        found = real()
        if not once:
            once.append(1)
            other.evolve([Column("theirs", "int", "t")])
        return found

    monkeypatch.setattr(log, "versions", late)
    assert [x.name for x in log.evolve([Column("mine", "int", "m")])] == ["a", "b", "theirs", "mine"]
    assert real() == [0, 1, 2, 3]
