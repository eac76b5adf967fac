from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.functions import literals, text
from riskweave.operators import catalog, consolidate, profiles
from riskweave.sources import tables


@pytest.fixture(scope="module")
def raw(spark):
    """Three entities: one in every table, one only looked up, one only matched."""

    def asked(name, country, kind):
        return f"[{{'entity_id': '{name}', 'query_value': 'Name of {name}', 'metadata': {{'country_code': '{country}', 'entity_type': '{kind}'}}}}]"

    sources = spark.createDataFrame(
        [
            (0, "CL-7", asked("CL-7", "PER", "PM"), "3"),
            (1, "CL-7", asked("CL-7", "PER", "PM"), "0"),
            (2, "SAT_69B-4", asked("SAT_69B-4", "CHL", "PF"), "2"),
        ],
        "ord long, entity_id string, query_used string, evidence_count string",
    )
    evidence = spark.createDataFrame(
        [(0, "CL-7", 0.35, "False"), (1, "CL-7", 0.62, "1"), (2, "CL-7", 0.41, "True"), (3, "SAT_69B-4", 0.2, "no")],
        "ord long, entity_id string, identity_score double, review_required string",
    )
    match = spark.createDataFrame(
        [(0, "CL-7", "Andes SA", "per", "PM", "LIST_A", "4.0", "[]", 0), (1, "CL-9", "Rosa Luz", "arg", "PF", "LIST_B", "1", "[]", 1)],
        "ord long, entity_id string, entity_name string, input_country string, input_entity_type string,"
        " sources_hit string, match_count string, matches_json string, is_suspicious_analyst int",
    )
    return sources, evidence, match


def test_catalog_takes_the_match_row_first(raw):
    rows = {r["entity_id"]: tuple(r)[1:] for r in catalog.entity_catalog(*raw).collect()}
    assert rows == {
        "CL-7": ("Andes SA", "MORAL", "PER"),
        "CL-9": ("Rosa Luz", "FISICA", "ARG"),
        "SAT_69B-4": ("Name of SAT_69B-4", "FISICA", "CHL"),
    }


def test_consolidation_counts_per_entity(raw):
    sources, evidence, match = raw
    out = consolidate.consolidate_catalog(catalog.entity_catalog(*raw), sources, evidence, match)
    names = ["sources_evaluated", "sources_with_hallazgo", "evidence_items", "review_items", "match_count", "sources_hit", "overall_decision"]
    rows = {r["entity_id"]: tuple(r[n] for n in names) for r in out.collect()}
    assert rows == {
        "CL-7": (2, 1, 3, 2, 4, "LIST_A", "needs_review"),
        "CL-9": (0, 0, 0, 0, 1, "LIST_B", "no_match"),
        "SAT_69B-4": (1, 1, 1, 0, 0, "", "accepted"),
    }
    assert {r["entity_id"]: (r["max_identity_score"], r["is_suspicious_analyst"]) for r in out.collect()} == {
        "CL-7": (0.62, 0), "CL-9": (0.0, 1), "SAT_69B-4": (0.2, 0)}


def test_duplicate_match_rows_keep_the_first(raw, spark):
    sources, evidence, match = raw
    twice = match.unionByName(match.withColumns({"ord": F.lit(5).cast("long"), "match_count": F.lit("9")}))
    out = consolidate.consolidate_catalog(catalog.entity_catalog(sources, evidence, twice), sources, evidence, twice)
    assert {r["entity_id"]: r["match_count"] for r in out.collect()} == {"CL-7": 4, "CL-9": 1, "SAT_69B-4": 0}
    assert consolidate.duplicate_matches(twice).first()["rows"] == 2


def test_without_match_summary(raw):
    sources, evidence, _ = raw
    out = consolidate.consolidate_catalog(catalog.entity_catalog(sources, evidence), sources, evidence)
    assert "is_suspicious_analyst" not in out.columns and out.count() == 2
    assert out.agg(F.sum("match_count")).first()[0] == 0


def test_country_rules(spark):
    df = spark.createDataFrame(
        [("", None), ("unknown", None), (None, None), ("mex", None), ("Mexico", "MEX"), ("Francia", None)],
        "raw string, mapped string",
    )
    got = [r[0] for r in df.select(text.country_code(F.col("raw"), F.col("mapped"))).collect()]
    assert got == ["DESCONOCIDO", "DESCONOCIDO", "DESCONOCIDO", "MEX", "MEX", "FRA"]


def test_review_modes(spark):
    df = spark.createDataFrame([(x,) for x in ("True", "1", "10", "untrue", "False")], "r string")
    strict = [r[0] for r in df.select(text.is_review(F.col("r"))).collect()]
    loose = [r[0] for r in df.select(text.is_review(F.col("r"), "loose")).collect()]
    assert strict == [True, True, False, False, False]
    assert loose == [True, True, True, True, False]


def test_literals_with_none_take_the_second_parser(spark):
    ddl = "array<struct<entity_id:string,metadata:struct<country_code:string>>>"
    df = spark.createDataFrame(
        [
            ("[{'entity_id': 'A', 'metadata': None}]",),
            ("[{'entity_id': \"B's\", 'metadata': {'country_code': 'X'}}]",),
            ("{'entity_id': 'C'}",),
            ("[broken",),
            (None,),
        ],
        "t string",
    )
    got = [r[0] for r in df.select(literals.parse_list(F.col("t"), ddl)).collect()]
    assert got[0][0]["entity_id"] == "A" and got[0][0]["metadata"] is None
    assert got[1][0]["entity_id"] == "B's"
    assert got[2:] == [None, None, None]


def test_json_objects_ignore_odd_elements(spark):
    df = spark.createDataFrame([('{"country":"X"}',), ('[{"country":"X"}, 5]',), ("[]",)], "t string")
    got = [r[0] for r in df.select(literals.json_objects(F.col("t"), "struct<country:string>")).collect()]
    assert got[0] is None
    assert [g["country"] for g in got[1]] == ["X"]
    assert got[2] == []


def test_to_long_never_raises(spark):
    df = spark.createDataFrame([("",), ("2.0",), ("x",), (" 7 ",), (None,)], "v string")
    assert [r[0] for r in df.select(text.to_long(F.col("v"))).collect()] == [None, 2, None, 7, None]


def test_profile_text_keeps_first_appearance(spark):
    cat = spark.createDataFrame([("A", "N", "OTRO", "MEX"), ("B", "M", "OTRO", "MEX")],
                                "entity_id string, entity_name string, entity_type string, country_code string")
    ev = spark.createDataFrame(
        [(0, "A", "z", ""), (1, "A", "a", "r"), (2, "A", "z", None)],
        "ord long, entity_id string, snippet string, review_reason string",
    )
    rows = {r["entity_id"]: r for r in profiles.profile_text(cat, ev).collect()}
    assert rows["A"]["all_evidence"] == "Fragmento: z ; Fragmento: a | Motivo: r"
    assert rows["B"]["all_evidence"] == "Sin evidencias recopiladas"
    assert rows["B"]["entity_profile_text"].startswith("Entidad: M | Tipo: OTRO | País: MEX | Evidencias: ")


def test_csv_round_trip_with_json_in_quotes(spark, tmp_path):
    path = tmp_path / "evidence_items.csv"
    path.write_text(
        "evidence_id,entity_id,identity_score,review_required,extra\n"
        'e1,A,0.5,True,"[{""k"": ""v, w""}]"\n'
        "e2,NaN,bad,None,x\n"
    )
    from riskweave.schemas import EVIDENCE

    rows = tables.read_csv(spark, str(path), EVIDENCE).orderBy("ord").collect()
    assert rows[0]["identity_score"] == 0.5 and rows[0]["entity_id"] == "A"
    assert rows[1]["entity_id"] is None and rows[1]["identity_score"] is None
    assert rows[1]["review_required"] is None
    assert "extra" not in rows[0].asDict()


def test_input_dir_and_focus(spark, tmp_path):
    (tmp_path / "train").mkdir()
    assert tables.resolve_input_dir(spark, str(tmp_path), "train").endswith("/train")
    assert tables.resolve_input_dir(spark, str(tmp_path), "use") == str(tmp_path)
    assert tables.read_focus(spark, str(tmp_path)) is None
    (tmp_path / "test.csv").write_text("entity_id\n" + "\n".join("A,B,C,D,E,F,G".split(",")))
    assert sorted(r["entity_id"] for r in tables.read_focus(spark, str(tmp_path)).collect()) == list("ABCDE")
