import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.plans import domain_queries, text_queries

SF = "/root/testdata/sf0.01"
NAMES = """fn_strip_think fn_strip_code fn_json_repair2 fn_json_repair_cjk fn_json_array_elems fn_search_fields fn_unescape fn_citations fn_entities fn_wikilinks
fn_frontmatter fn_vision_content fn_detect_year st_sse""".split()


@pytest.mark.parametrize("name", NAMES)
def test_every_row_of_the_table(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracles()[name]).fetchall()
    assert df.columns == [c[0] for c in con.description]
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[-1] for r in got}) > 2


def test_null_and_empty_texts(spark, tmp_path):
    """A null text is read as an empty one, by the query and by the oracle."""
    rows = [(1, None, "fr", "web"), (2, "", "de", "web"), (3, "  a  *b* [[c]] \n", "en", "book")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", " x \n y ")], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    for name in NAMES:
        if name != "fn_detect_year":
            got = [tuple(r) for r in registry.queries()[name](spark, path).collect()]
            assert sorted(got, key=str) == sorted(con.execute(registry.oracles()[name]).fetchall(), key=str), name


def test_odd_inputs(spark):
    assert set(NAMES) <= set(domain_queries.CASES) and text_queries
    for name, (cases, f) in domain_queries.CASES.items():
        if name in NAMES:
            got = {r.given: r.y for r in spark.createDataFrame([(g,) for g in cases], "given string").select("given", f(F.col("given")).alias("y")).collect()}
            assert got == cases, name
