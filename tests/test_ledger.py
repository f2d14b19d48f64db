import os

import pytest

from prepkit.plans import consolidate, ledger
from prepkit.sources import commits
from prepkit.sources.files import list_csv


def put(path, text, when=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if when:
        os.utime(path, (when, when))


def actions(df):
    return sorted((r["path"].rsplit("/", 1)[-1] if r["path"] else r["uri"].rsplit("/", 1)[-1], r["action"]) for r in df.collect())


def same_as_anew(spark, raw, out):
    rows, _, _ = consolidate.consolidate(spark, list_csv(spark, raw))
    got = ledger.current(spark, out)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in rows.schema}
    assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_runs_read_what_is_new(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    put(tmp_path / "raw/a.csv", "id,v\n1,2\n2,\n", 1_000_000)
    put(tmp_path / "raw/b.csv", 'id,v\n3,"x\ny"\n', 1_000_000)
    put(tmp_path / "raw/deep/c.csv", "v,w\n1.5,true\n", 1_000_000)
    put(tmp_path / "raw/bad.csv", b"id,v\n1,\xff\n", 1_000_000)
    put(tmp_path / "raw/empty.csv", "", 1_000_000)
    assert {a for _, a in actions(ledger.update(spark, raw, out, "one"))} == {"read"}
    same_as_anew(spark, raw, out)
    assert ledger.failures(spark, out).count() == 2
    assert {a for _, a in actions(ledger.update(spark, raw, out, "two"))} == {"keep"}
    # One changed so that the type of its column narrows, one touched only, one removed, one new.
    put(tmp_path / "raw/b.csv", "id,v\n3,7\n4,8\n", 2_000_000)
    put(tmp_path / "raw/a.csv", "id,v\n1,2\n2,\n", 2_000_000)
    os.remove(tmp_path / "raw/deep/c.csv")
    put(tmp_path / "raw/d.csv", "w\nfalse\n", 2_000_000)
    assert actions(ledger.update(spark, raw, out, "three")) == [
        ("a.csv", "read"), ("b.csv", "read"), ("bad.csv", "keep"), ("c.csv", "drop"), ("d.csv", "read"), ("empty.csv", "keep")]
    same_as_anew(spark, raw, out)
    runs = {r["uri"].rsplit("/", 1)[-1]: r["run"].split("-")[0] for r in commits.read(spark, f"{out}/ledger").collect()}
    assert runs["a.csv"] == "one" and runs["b.csv"] == "three"
    written = commits.read(spark, f"{out}/cells").where("run LIKE 'three-%'").select("uri").distinct().collect()
    assert sorted(r["uri"].rsplit("/", 1)[-1] for r in written) == ["b.csv", "d.csv"]


def test_a_run_that_fails_midway(spark, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    put(tmp_path / "raw/a.csv", "id,v\n1,2\n")
    ledger.update(spark, raw, out, "one")
    put(tmp_path / "raw/b.csv", "id,v\n3,4\n")
    with monkeypatch.context() as patch:
        patch.setattr(commits, "overwrite", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.update(spark, raw, out, "two")
    assert ledger.current(spark, out).count() == 1  # cells are there, the ledger does not name them
    put(tmp_path / "raw/b.csv", "id,v\n3,5\n5,6\n")  # and the file changes before the next attempt
    ledger.update(spark, raw, out, "two")
    same_as_anew(spark, raw, out)
    assert ledger.update(spark, raw, out, "two").count() == 0
    same_as_anew(spark, raw, out)


def test_folders(spark, tmp_path):
    put(tmp_path / "raw/school/edunomics/a.csv", "id\n1\n")
    done = ledger.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "one")
    assert list(done) == [("school", "edunomics")] and ledger.current(spark, str(tmp_path / "out/school_edunomics")).count() == 1
