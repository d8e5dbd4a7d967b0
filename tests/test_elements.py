"""JSON containers cut anywhere, against the json module."""

import json
import random

import pytest

from corpusloom.operators import elements as E
from corpusloom.sources import model_io, records

SCALARS = [1, -2.5, None, True, "", "a,b", 'q"\\\\"[', "}{][", "\\\\", "\u00e9\u4e2d\U0001f600", "\n", {}, [], {"r": [1, 2]}, [[], [{}]], {"a": "]", "b": [",", {"c": "\\"}]}]


def cut_up(rng, text, most):
    at, out = 0, []
    while at < len(text):
        step = rng.randint(0, most)
        out.append(text[at : at + step])
        at += step
    return out


def parts(spark, texts, most=5, seed=1):
    rng = random.Random(seed)
    rows = [(g, i * 3, p) for g, t in texts.items() for i, p in enumerate(cut_up(rng, t, most))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "group string, part bigint, text string").repartition(5)


def values(frame):
    got = {}
    for r in E.numbered(frame).orderBy("position").collect():
        got.setdefault((r.group, r.key), []).append(r["item"])
    return got


@pytest.mark.parametrize("most", [1, 4, 40, 4000])
def test_elements_are_those_of_the_json_module(spark, most):
    rng = random.Random(most)
    arrays = {f"g{n}": [rng.choice(SCALARS) for _ in range(rng.randint(0, 12))] for n in range(25)}
    texts = {g: json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for g, v in arrays.items()}
    items, verdicts = E.elements(parts(spark, texts, most))
    assert {g: [json.loads(t) for t in v] for (g, _), v in values(items).items()} == {g: v for g, v in arrays.items() if v}
    assert all(r.is_array for r in verdicts.collect()) and verdicts.count() == 25

    maps = {g: {"x": v, "r": v, "n": "r", "m": {f"k{i},": x for i, x in enumerate(v)}, "z": {"r": [7]}} for g, v in arrays.items()}
    texts = {g: json.dumps(v, indent=rng.choice([None, 1])) for g, v in maps.items()}
    got = values(E.elements(parts(spark, texts, most), "r", "m")[0])
    for g, v in maps.items():
        assert [json.loads(t) for t in got.get((g, "r"), [])] == v["r"]
        assert json.loads("{" + ",".join(got.get((g, "m"), [])) + "}") == v["m"]


def test_what_is_no_array(spark):
    texts = {"ok": " [1] ", "empty": "[]", "cut": "[1, 2", "string": '[1, "a]', "two": "[1][2]", "map": '{"a": 1}', "wrong": "[1}", "text": "x [1]", "after": "[1] y", "close": "]["}
    for most in (1, 3, 50):
        assert {r.group: r.is_array for r in E.elements(parts(spark, texts, most))[1].collect()} == {t: t in ("ok", "empty") for t in texts}


def test_an_unfinished_text_gives_its_finished_elements(spark):
    texts = {"a": '{"r": [{"t": 1}, {"t": 2}', "b": '{"r": [{"t": 1}, {"t": ', "c": '{"r": [{"t": 1}, ', "d": '{"r": ["x', "e": '{"r": ', "f": ""}
    for most in (1, 4, 50):
        got = values(E.elements(parts(spark, texts, most), "r")[0])
        assert {g: len(v) for (g, _), v in got.items()} == {"a": 2, "b": 1, "c": 1}


def test_record_files_are_read_in_splits(spark, tmp_path):
    made = [{"id": f"d{i}", "title": f"T, {i} \u4e2d", "passages": [{"id": "p", "text": "x,] " * (i % 9), "locator": "l"}]} for i in range(4000)]
    (tmp_path / "one.json").write_text(json.dumps(made, ensure_ascii=False), encoding="utf-8")
    for name, body in {"bad": "[{broken", "middle": "[{}, {,}, {}]", "gap": "[{},,{}]", "end": "[{},]", "none": "[]", "nulls": "[null, {}]"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert E.file_parts(spark, str(tmp_path)).select("group", "part").distinct().count() > 10
        rows = records.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    named = [(r["file"].rsplit("/", 1)[1], r) for r in rows]
    assert sorted((n, r.idx, r.parse_error) for n, r in named if n != "one.json") == [
        ("bad.json", 0, True), ("end.json", 0, True), ("gap.json", 0, True), ("middle.json", 0, True), ("nulls.json", 1, False),
    ]
    whole = sorted((r.idx, r.id, r.title, r.passages[0].text) for n, r in named if n == "one.json")
    assert whole == [(i, m["id"], m["title"], m["passages"][0]["text"]) for i, m in enumerate(made)]


def test_vector_cache_round_trip(spark, tmp_path):
    rows = [(f'h"{i}, ', [i / 7, -1e-9, 3.0], f"2024-{i}" if i % 3 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "input_hash string, vector array<double>, generated_at string").repartition(3)
    model_io.write_vector_cache(frame, str(tmp_path / "c"), "m", 3)
    for file in (tmp_path / "c").glob("*.txt"):
        assert json.loads(file.read_text())["dimensions"] == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r.input_hash: tuple(r) for r in model_io.read_vector_cache(spark, str(tmp_path / "c"), "*.txt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {h: ("m", 3, h, v, t or model_io.UNKNOWN_TIME) for h, v, t in rows}
    none = frame.limit(0)
    model_io.write_vector_cache(none, str(tmp_path / "e"), "m", 3)
    assert model_io.read_vector_cache(spark, str(tmp_path / "e"), "*.txt").count() == 0
