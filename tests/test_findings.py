"""Cases that the round's findings name, over tables small enough to check by their SQL."""

import duckdb

from corpusloom.plans import ORACLES, QUERIES


def against_sql(spark, folder, name, tables):
    """The query over `tables` (name to SELECT) written below `folder`, and its SQL on the same files."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    wanted = con.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    got = QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted((tuple(r) for r in got), key=repr), sorted(wanted.fetchall(), key=repr)


def test_resolution_counts_keep_a_request_that_does_not_fail(spark, tmp_path):
    lines = """SELECT CASE WHEN i < 15 THEN 1 ELSE 2 END::BIGINT AS l_orderkey, i::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, (i % 7 + 1)::INT AS l_linenumber,
      CASE WHEN i IN (3, 4, 12, 17) THEN 'R' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus FROM range(18) t(i)"""
    got, wanted = against_sql(spark, tmp_path, "resolution_failures", {"lineitem": lines})
    assert got == wanted
    assert (1, 12, 3, 0) in got


def test_a_thousand_keys_take_two_state_calls_a_batch():
    import pandas as pd

    from corpusloom.streaming import state

    calls = []

    class Handle:
        def __getattr__(self, name):
            def call(*given):
                calls.append((name, *given))
                return self if name == "getValueState" else None

            return call

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    for processor, values in (
        (state.Shared(["k"], 10), {"us": 5}), (state.Seen(["k"], 10), {"film": "f", "us": 5}),
        (state.Progress(["k", "span_end"]), {"span_end": 9, "us": 5, "seq": 1, "stage": "s", "steps": 1, "terminal_steps": 0}),
        (state.Sessions(["k"]), {"start": 5, "end": 9, "steps": 1, "finished": False}),
    ):
        calls.clear()
        rows = pd.DataFrame({"key": [str(i) for i in range(1_000)], **{n: [v] * 1_000 for n, v in values.items()}})
        processor.columns = list(rows.columns)
        processor.init(Handle())
        out = list(processor.handleInputRows((7,), iter([rows]), Timers()))
        assert sum(map(len, out)) == (0 if isinstance(processor, state.Sessions) else 1_000)
        assert sorted(c[0] for c in calls) == ["get", "getValueState", "registerTimer", "update"]


def test_short_responses_are_parsed_as_the_long_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusloom.operators import elements as E, sequences as S

    film = '{"t":"a, [b]","y":1990.0,"d":"x"}'
    texts = [
        f'{{"v":"lens","r":[{film}, {{"t":"no","y":1990.5,"d":"x"}}, 7, {film}]}}', f'{{"r":[{film},{film}', f'{{"r":[{film},{{"t":"cut', f'{{"r":[ ]}}',
        f'{{"r":[{film}]}}{{"r":[{film}]}}', f'{{"r":[{film}],"r":[{film},{film}]}}', f'{{"\\u0072":[{film}]}}', f'[{{"r":[{film}]}}]', f'{{"r":{{"a":{film}}}}}',
        f'{{"r":[{film}]}}][{{"r":[{film}]}}', "", " ", f'{{"r":[{film},]}}', f'{{"q":[{film}]}}', f'{{"r":[\n{film}\n,{film}\t]}} ', f'{{"r":[{film}]}}}}', "null", f'{{"r":null}}',
    ]
    deltas = [(f"{i:02}", n, text[n * 5 : n * 5 + 5], "delta") for i, text in enumerate(texts) for n in range(-(-len(text) // 5) or 1)]
    frame = spark.createDataFrame(deltas, "request_id string, seq bigint, delta string, event string")
    got = sorted((r.request_id, r.position, r.t, r.y, r.d) for r in S.reassemble_rows(frame)[0].collect())
    parts = spark.createDataFrame([(f"{i:02}", 0, t) for i, t in enumerate(texts)], "group string, part bigint, text string")
    items = E.elements(parts, "r")[0].select("group", "part", "idx", F.try_parse_json(F.trim("item")).alias("v"))
    rows = E.numbered(items.where(S._proposes(F.col("v"))).select("group", "part", "idx", *S._proposal(F.col("v"))))
    assert got == sorted((r.group, r.position, r.t, r.y, r.d) for r in rows.collect())
    assert len(got) >= 12
    # No response of one part takes the way of parts, which goes through all texts thrice.
    monkeypatch.setattr(S, "elements", None)
    assert S.reassemble_rows(frame)[0].count() == len(got)


def test_python_workers_are_handed_a_bounded_number_of_bytes(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from corpusloom.session import ARROW_BYTES, load

    spark.range(200).select("id", F.repeat(F.lit("x"), F.lit(200_000)).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    most = load(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "bytes bigint").groupBy().max().first()[0]
    # The batch ends with the row that reaches the bound, and buffers are rounded up.
    assert most <= 2 * ARROW_BYTES


def test_parts_of_files_are_bounded_whatever_the_split(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.operators import elements as E

    record = '{"a":"' + "y" * 990 + '"}'
    (tmp_path / "one.json").write_text("[" + ",".join([record] * 2_000 + ['"' + "z" * (2 * E.PART_CHARS) + '"']) + "]")
    parts = E.file_parts(spark, str(tmp_path)).cache()
    lengths = sorted(r.n for r in parts.select(F.length("text").alias("n")).collect())
    assert lengths[-2] <= E.PART_CHARS + 1_000 and len(lengths) >= 8
    items, verdicts = E.elements(parts, keep=False)
    assert sorted(len(r.item) for r in items.collect()) == [len(record)] * 2_000 + [2 * E.PART_CHARS + 2]
    assert verdicts.first().is_array


def test_candidates_normalise_a_text_once(spark):
    from corpusloom.operators import admission as A
    from corpusloom.schemas import CANDIDATE

    rows = spark.createDataFrame([], f"target_id string, source_text string, {CANDIDATE}")
    plan = A.audit_candidates(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_blocks_move_in_teams_and_lose_no_neighbour(spark, monkeypatch):
    from functools import partial

    import numpy as np
    from test_matching import brute_neighbours

    from corpusloom.operators import vectors as V

    rng = np.random.default_rng(8)
    # The last ones lie in one ring around one pivot, which is cut into parts.
    wide = rng.normal(size=(500, 12))
    tight = np.ones(12) + rng.normal(size=(300, 12)) * 1e-5
    vectors = {i: v.tolist() for i, v in enumerate(np.concatenate([wide, tight]))}
    frame = spark.createDataFrame(list(vectors.items()), "id int, vector array<double>").repartition(3)
    for rows in (3, 40):
        blocks = V.pivot_blocks(frame.select("id", V.l2_normalize("vector").alias("vector")), rows)
        held = blocks.groupBy("team").agg({"block": "count"}).count()
        assert held < blocks.select("block").distinct().count() / 2
        assert blocks.select("team", "at").distinct().count() == blocks.select("block").distinct().count() == blocks.select("team", "at", "block").distinct().count()
        assert blocks.agg({"at": "max"}).first()[0] < 62
        monkeypatch.setattr(V, "pivot_blocks", partial(V.pivot_blocks, rows=rows))
        got = {}
        for e in V.nearest_neighbours(frame.where("id < 500"), 5, 0.4, method="exact").collect():
            got.setdefault(e.src, {})[e.place] = e.dst
        wanted = brute_neighbours({i: v for i, v in vectors.items() if i < 500}, 5, 0.4)
        assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == {i: b for i, b in wanted.items() if b}
        near = V.nearest_neighbours(frame, 5, 0.4, method="exact").where("src >= 500")
        assert near.count() == 1_500 and near.where("dst < 500 OR score < 0.999").count() == 0
        monkeypatch.undo()


def test_tasks_sort_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    import pytest

    from corpusloom import session

    lines = """SELECT (i // 4)::BIGINT AS l_orderkey, (i % 37)::BIGINT AS l_partkey, (i % 11)::BIGINT AS l_suppkey, (i % 4 + i // 4 % 2)::INT AS l_linenumber,
      ['N', 'A', 'R'][i % 3 + 1] AS l_returnflag, ['O', 'F'][i % 5 // 3 + 1] AS l_linestatus FROM range(400) t(i)"""
    tables = {
        "lineitem": lines, "supplier": "SELECT i::BIGINT AS s_suppkey, (i % 3)::INT AS s_nationkey FROM range(9) t(i)",
        "orders": "SELECT i::BIGINT AS o_orderkey, ['F', 'O', 'P'][i % 3 + 1] AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(100) t(i)",
    }
    dealt = []
    if not hasattr(session, "dealt"):
        pytest.fail("tasks are sized by compressed bytes")
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    kept = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *keys: dealt.append(n) or kept(self, n, *keys))
    for name in ("contract_violations", "withdraw_evidence", "edge_recommend"):
        dealt.clear()
        (tmp_path / name).mkdir()
        got, wanted = against_sql(spark, tmp_path / name, name, tables)
        assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got] == wanted and wanted
        assert max(dealt) >= 18


def test_hashed_features_are_counted_in_teams_and_never_rows(spark, monkeypatch):
    import math
    import random
    import re
    from collections import Counter

    from corpusloom.functions import features as X
    from corpusloom.operators import vectors as V

    rng = random.Random(5)
    said = [" ".join(rng.choices(["light", "shadow", "água", "영화", "x1", "a_b", "😀ok"], k=rng.randrange(30))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(said)] + [(90, None), (91, ""), (92, "y" * 5000 + " light"), (None, "a\n\n b")]

    def parts(text):
        text = text.lower()
        words, flat = re.findall(r"[^\W_]+", text), re.sub(r"\s+", " ", text)
        yield from ("w:" + w for w in words)
        yield from (f"b:{a}_{b}" for a, b in zip(words, words[1:]))
        yield from ("c:" + flat[i : i + 3] for i in range(len(flat) - 2))

    def fnv(text, value):
        units = text.encode("utf-16-le")
        for at in range(0, len(units), 2):
            value = (value ^ int.from_bytes(units[at : at + 2], "little")) * X.FNV_PRIME % 2**32
        return value

    counted = [(i, Counter(parts(t))) for i, t in rows if t is not None]
    df, wanted = Counter(f for _, c in counted for f in c), Counter()
    for i, c in counted:
        for f, tf in c.items():
            idf = math.log((len(rows) + 1) / (df[f] + 1)) + 1
            sign = 1 if fnv(f, X.SIGN_SEED) % 2 else -1
            wanted[i, fnv(f, X.BUCKET_SEED) % V.DIMENSIONS] += sign * (1 + math.log(tf)) * idf
    frame = spark.createDataFrame(rows, "id int, text string")
    for chars, broadcast in ((2 << 20, 16), (100, 0)):
        monkeypatch.setattr(V, "TEAM_CHARS", chars)
        monkeypatch.setattr(V, "BROADCAST_TEAMS", broadcast)
        weights = V.hashed_tfidf(frame)
        assert "Generate" not in weights._jdf.queryExecution().executedPlan().toString()
        got = [((r.id, r.bucket), r.weight) for r in weights.collect()]
        assert len(got) == len(wanted) and all(math.isclose(w, wanted[k], abs_tol=1e-6) for k, w in got)
