"""Text functions over whole tables: every row's own text is wrapped as a model, a note or a stream would send it, and the oracle says from the row's columns what
must come out. What odd inputs give is held by the cases of ``domain_queries.CASES``, in a test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import parse
from ..registry import query
from ..sources import files


def on_texts(name: str, table: str, keys: str, given: str, f: Callable[[Column], Column], want: str) -> None:
    """A query that applies f to ``given`` (Spark SQL over the table's columns) in every row, and its oracle."""
    columns = keys.split()
    query(name, f"select {', '.join(columns)}, {want} as y from {table}")(
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("_given", F.expr(given)).select(*columns, f(F.col("_given")).alias("y")))


def _join(a: Column) -> Column:
    return F.array_join(a, "|")


DOC, TURN = "doc_id", "conv_id turn"
TEXT = "coalesce(text, '')"
TRIMMED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
WORDS = f"string_split(replace(replace({TEXT}, chr(10), ' '), '*', ''), ' ')"
NAMES = f"string_split(translate({TEXT}, '[]|' || chr(10), '    '), ' ')"

on_texts("fn_strip_think", "conversations", TURN, rf"concat('<think>', role, '\n', turn, '</think>', {TEXT}, '<think>', {TEXT}, '</think>')", parse.strip_think, TRIMMED)
on_texts("fn_strip_code", "conversations", TURN, rf"concat('```json\n', {TEXT}, '\n```')", parse.strip_code, TRIMMED)
on_texts("fn_json_repair2", "conversations", TURN, rf"""concat('Sure: <think>', {TEXT}, '</think>```json\n{{"conv":', conv_id, ',"turn":', turn, ',"role":"', role, '",}}\n```')""", parse.lenient_json,
    """'{"conv":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}'""")  # fmt: skip
on_texts("fn_json_repair_cjk", "conversations", TURN, "concat('得 {“conv”：', conv_id, '，“turn”：', turn, '，“role”：“', role, '”} 完')", parse.cjk_json,
    """'{"conv":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}'""")  # fmt: skip
on_texts("fn_json_array_elems", "documents", DOC, f"""concat('[{{"id":"', lang, '"}},', doc_id, ',{{"name":"', source, '"}},', substr(to_json(split({TEXT}, ' ')), 2))""", lambda c: _join(parse.json_array_elements(c)),
    f"array_to_string(list_filter(list_prepend(lang, string_split({TEXT}, ' ')), lambda x: x <> ''), '|')")
on_texts("fn_search_fields", "documents", DOC, f"to_json(named_struct('clue', {TEXT}, 'analysis', source, 'other', lang))", lambda c: _join(parse.search_fields(c)),
    f"array_to_string(list_filter([lower(source), lower({TEXT})], lambda x: x <> ''), '|')")
on_texts("fn_unescape", "documents", DOC, rf"""concat(replace({TEXT}, '\n', '\\n'), '\\"', source, '\\"', '\\\\')""", parse.unescape, TEXT + """ || '"' || source || '"\\'""")
on_texts("fn_citations", "documents", DOC, f"concat({TEXT}, ' [^', doc_id % 100, '^] [^', length({TEXT}), '^][^', doc_id % 100, '^] [^x^] [^1]')", lambda c: _join(parse.citations(c)),
    f"array_to_string(list_sort(list_distinct([cast(doc_id % 100 as varchar), cast(length({TEXT}) as varchar)])), '|')")
on_texts("fn_entities", "documents", DOC, rf"concat('**', replace(replace(replace({TEXT}, '\n', ' '), '*', ''), ' ', '** **'), '**')", lambda c: _join(parse.entities(c)),
    f"array_to_string(list_sort(list_distinct({WORDS}))[1:20], '|')")
on_texts("fn_wikilinks", "documents", DOC, rf"concat('[[ ', replace(translate({TEXT}, '[]|\n', '    '), ' ', ']] [[ '), '|alias]] [D]')", lambda c: _join(F.array_sort(files.wiki_links(c))),
    f"array_to_string(list_sort(list_distinct({NAMES})), '|')")
on_texts("fn_frontmatter", "documents", DOC, rf"""concat('---\nname: "', source, '"\nid: ', doc_id, '\n---\n', {TEXT}, '\n---\nid: no\n---')""", lambda c: F.concat_ws(",", files.frontmatter(c, "id"), files.frontmatter(c, "name")),
    "doc_id || ',' || source")
on_texts("fn_vision_content", "documents", DOC, TEXT, lambda c: parse.vision_content(c, F.array("source", "lang")), rf"regexp_replace({TEXT} || chr(10) || chr(10) || '【公式】' || chr(10) || source || chr(10) || lang, '^\s+', '')")
on_texts("fn_detect_year", "orders", "o_orderkey", "concat(o_orderpriority, ' ', year(o_orderdate) + 6, '年卷')", parse.detect_year,
    "case when year(o_orderdate) + 6 between 2000 and 2099 then cast(year(o_orderdate) + 6 as int) end")
on_texts("st_sse", "conversations", TURN, rf"""concat('event: metadata\ndata: {{"turn":', turn, '}}\n\n', array_join(transform(split({TEXT}, ' '), w -> concat('event: content\ndata: ', to_json(named_struct('content', concat(w, ' '))), '\n\n')), ''),
    case when role = 'user' then 'event: error\ndata: no\n\n' when turn % 3 = 1 then 'event: done\ndata: {{}}\n\n' else '' end)""",
    lambda c: F.concat_ws("/", parse.tutor_stream(c)["metadata"], parse.tutor_stream(c)["content"], parse.tutor_stream(c)["state"]),
    f"""'{{"turn":' || turn || '}}/' || {TEXT} || ' /' || case when role = 'user' then 'error' when turn % 3 = 1 then 'done' else 'open' end""")
