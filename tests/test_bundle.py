import hashlib
import json

import pytest

from attesta.sources import bundle


def tables(spark, text="fine"):
    return {"units": spark.createDataFrame([("1.1", "a"), ("1.2", text)], "id string, text string"), "items": spark.createDataFrame([("q", 1)], "item string, n int")}


def test_publish(spark, tmp_path):
    at = bundle.publish(tables(spark), str(tmp_path), "v1", tokens=["secret"], parts=["gold"], folders=["raw"])
    listed = [json.loads(x) for p in (tmp_path / "v1/manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert sum(x["lines"] for x in listed if x["path"].startswith("units/")) == 2
    for x in listed:
        assert hashlib.sha256((tmp_path / "v1" / x["path"]).read_bytes()).hexdigest() == x["sha256"]
    assert [p.name for p in tmp_path.iterdir()] == ["v1"] and bundle.differences(spark, at).count() == 0
    with pytest.raises(FileExistsError):
        bundle.publish(tables(spark), str(tmp_path), "v1")


@pytest.mark.parametrize("bad", [{"text": "a secret here"}, {"text": 'say "se\\cret"'}])
def test_forbidden_token(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="forbidden"):
        bundle.publish(tables(spark, **bad), str(tmp_path), "v1", tokens=["secret", 'say "se\\cret"'])
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("name", ["units/extra.json", "units/gold.json", "raw/part.json"])
def test_what_slips_in_between(spark, tmp_path, monkeypatch, name):
    """What is checked is what lies in the staging folder, not the tables."""
    write = bundle._write

    def slipping(rows, path):
        write(rows, path)
        from pathlib import Path

        own = Path(path).parent / name
        own.parent.mkdir(exist_ok=True)
        own.write_text('{"text": "secret"}\n' if "extra" in name else "{}\n")

    monkeypatch.setattr(bundle, "_write", slipping)
    with pytest.raises(ValueError, match="forbidden"):
        bundle.publish(tables(spark), str(tmp_path), "v1", tokens=["secret"], parts=["gold"], folders=["raw"])
    assert list(tmp_path.iterdir()) == []


def test_differences(spark, tmp_path):
    at = bundle.publish(tables(spark), str(tmp_path), "v1")
    (tmp_path / "v1/units/more.json").write_text("{}\n")
    item = next((tmp_path / "v1/items").glob("part-*"))
    item.write_text("{}\n")
    for p in item.parent.glob(".*.crc"):
        p.unlink()
    gone = next((tmp_path / "v1/units").glob("part-*"))
    gone.unlink()
    got = {(r["path"].split("/")[0], r["what"]) for r in bundle.differences(spark, at).collect()}
    assert got == {("units", "extra"), ("items", "changed"), ("units", "missing")}


def test_empty_files(spark, tmp_path):
    """A part of 0 bytes is in the manifest, so that it can be missing, changed or extra; its name is looked at, too."""
    at = bundle.publish({"none": tables(spark)["units"].limit(0), **tables(spark)}, str(tmp_path), "v1")
    part = next((tmp_path / "v1/none").glob("part-*"))
    assert part.stat().st_size == 0 and bundle.differences(spark, at).count() == 0
    part.rename(part.with_name("gold.json"))
    got = {(r["path"], r["what"]) for r in bundle.differences(spark, at).collect()}
    assert got == {(f"none/{part.name}", "missing"), ("none/gold.json", "extra")}
    assert [(r["path"].rsplit("/", 1)[1], r["found"]) for r in bundle.offences(spark, at, parts=["gold"]).collect()] == [("gold.json", "name")]
