"""Table functions in SQL texts against the operator for data frames."""

from pyspark.sql import functions as F

from kgloom.functions import tables
from kgloom.operators import kg

TEXTS = [
    "entity<|#|> Alice <|#|>person<|#|>a girl\nrelation<|#|>Alice<|#|>Bob<|#|>knows<|#|>well<|#|>more",
    "  entity<|#|>A<|#|>b<|#|>c  \n\nnoise\nentity<|#|>short\n<|COMPLETE|>\nentity<|#|>late<|#|>x<|#|>y",
    None,
    "",
    "<|COMPLETE|>",
    "relation<|#|>a<|#|>b<|#|>c\nentity<|#|><|#|><|#|>",
    "\t entity<|#|>tab<|#|>x<|#|>y",
]


def test_extraction_lines(spark):
    tables.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string").repartition(3)
    got = spark.sql("SELECT id, line_no, kind, name, target, type, description FROM {rows}, LATERAL extraction_lines(content)", rows=rows)
    entities, rels = kg.parsed(rows, ["id"])
    want = entities.select("id", "line_no", F.lit("entity"), "name", F.lit(None), "type", "description").union(rels.select("id", "line_no", F.lit("relation"), "source", "target", "type", "description"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(got) == key(want) and got.count() == 4


def test_lines_of_a_batch(spark):
    tables.register(spark)
    text = "doc_id:7<|#|>entity<|#|>A<|#|>t<|#|>d\ndoc_id:-8<|#|>relation<|#|>A<|#|>B<|#|>t<|#|>d\ndoc_id:x<|#|>entity<|#|>A<|#|>t<|#|>d\ndoc_id:99999999999999999999<|#|>entity<|#|>A<|#|>t<|#|>d"
    got = spark.sql("SELECT doc_id, kind FROM extraction_lines(:text)", args={"text": text}).collect()
    assert [tuple(r) for r in got] == [(7, "entity"), (-8, "relation")]


def test_all_cores_parse(spark, small, capsys):
    """A table of one row group is dealt to several tasks, and a call doesn't make an Arrow batch of its own."""
    from kgloom.queries import knowledge

    found = knowledge.parse_delimited_sql(spark, small)
    assert found.rdd.getNumPartitions() > 1
    found.explain()
    assert "ArrowEvalPythonUDTF" not in capsys.readouterr().out
