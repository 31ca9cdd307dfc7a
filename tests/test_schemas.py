from pyspark.sql import functions as F

from factloom import schemas

HEX = "0123456789ab" * 5 + "0123"


def test_every_record_has_a_schema_and_rules_that_run(spark):
    for name in schemas.names():
        df = schemas.empty(spark, name)
        assert df.columns == [c for c, *_ in schemas.columns(name)]
        assert schemas.violations(name, df).collect() == [] and schemas.missing_or_extra(name, df) == []


def test_span_rules(spark):
    good = ("es_" + HEX[:20], "eu_" + HEX[:20], 0, 5, 1, 1, HEX, "hello", "prose")
    bad = ("es_X", "eu_" + HEX[:20], 5, 5, 0, 1, HEX, "", "poem")
    df = spark.createDataFrame([good, bad, (None, *good[1:])], schemas.schema("evidence_spans").simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    got = sorted((str(r.record_id), r.detail) for r in schemas.violations("evidence_spans", df).collect())
    assert got == [("None", "evidence_span_id: null"), ("es_X", "content: len:1.."), ("es_X", "end_offset > start_offset"), ("es_X", "evidence_span_id: id:es"), ("es_X", "span_kind: in:prose|list-item|table-row|media|code|link|other"), ("es_X", "start_line: ge:1")]


def test_dispositions_concepts_and_probes(spark):
    d = spark.createDataFrame([("es_" + HEX[:20], "eu_" + HEX[:20], "extracted", ["a", "a"], None), ("es_" + HEX[:20], "eu_" + HEX[:20], "no-claim", [], None)], schemas.schema("span_dispositions"))
    assert sorted(r.detail[:15] for r in schemas.violations("span_dispositions", d).collect()) == ["claim_ids: uniq", "if(status = 'ex"]
    c = spark.createDataFrame([("concept_abc", "L", [], [], [], ["concept_x"], ["is-a", "eats"], "active")], schemas.schema("concepts"))
    assert len(schemas.violations("concepts", c).collect()) == 2
    p = spark.createDataFrame([("probe_abc", "gold", "q", "answer", [], "codex", "a", "too")], schemas.schema("probes"))
    assert sorted(r.detail for r in schemas.violations("probes", p).collect()) == ["kind != 'gold' OR author_type = 'human'", "rationale: len:8..2000"]
    assert schemas.missing_or_extra("probes", p.drop("kind").withColumn("x", F.lit(1)).withColumn("author_id", F.lit(1))) == ["missing kind", "type of author_id", "unknown x"]
