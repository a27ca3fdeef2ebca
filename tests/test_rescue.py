import json

import pytest

from tablewise.sources import files


def test_every_line_is_kept(spark, tmp_path):
    lines = ["id,day,at,ok,code,note,share", *(f"{i},2024-01-{i:02d},2024-01-01T10:00:{i:02d},true,00{i},a{i},{i}.5" for i in range(1, 20))]
    lines += ["late,2024-13-45,noon,perhaps,7,,many", "21,2024-01-21", '22,"open,2024-01-01 00:00:00,true,1,b,1.0', "23,2024-01-23,2024-01-01 00:00:00,false,1,b,1.0,more"]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    got = files.read_csv_rescued(spark, str(tmp_path / "x.csv"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "date", "timestamp", "boolean", "string", "string", "double", "string"]
    rows = got.collect()
    assert len(rows) == 23 and sum(r["_rescued"] is None for r in rows) == 19
    odd = [json.loads(r["_rescued"]) for r in rows if r["_rescued"]]
    assert {"id": "late", "day": "2024-13-45", "at": "noon", "ok": "perhaps", "share": "many"} in odd
    assert sorted(x["_line"] for x in odd if "_line" in x) == sorted(lines[-3:])
    assert all(r["id"] is None for r in rows if r["_rescued"])
    # Also where few columns are asked for.
    assert sorted(r.id for r in got.select("id").where("id is not null").collect()) == list(range(1, 20))


@pytest.mark.parametrize("text", ["a,b\n", "a,b\n1,\n,2\n"])
def test_empty_files_and_empty_cells(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    got = files.read_csv_rescued(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b", "_rescued"] and [tuple(r) for r in got.collect()] == ([] if text == "a,b\n" else [(1, None, None), (None, 2, None)])


def test_taken_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("_rescued,_line\n1,2\n3\n")
    got = files.load_folder(spark, str(tmp_path), "csv_rescued")["x"]
    assert got.columns == ["_rescued", "_line", "_rescued_1"] and [json.loads(r[2]) for r in got.collect() if r[2]] == [{"_line_1": "3"}]
