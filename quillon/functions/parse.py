"""Functions over model output, questions and file names: every one is a Column expression.

Null input gives null, or an empty array where the result is one, unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

# fixed values: provinces and the words that mark a subject, in the order in which they are tried
PROVINCES = {
    "北京": "beijing", "上海": "shanghai", "天津": "tianjin", "山东": "shandong", "广东": "guangdong", "浙江": "zhejiang", "江苏": "jiangsu", "河南": "henan",
    "四川": "sichuan", "河北": "hebei", "湖北": "hubei", "湖南": "hunan", "福建": "fujian", "安徽": "anhui", "辽宁": "liaoning", "重庆": "chongqing",
    "江西": "jiangxi", "贵州": "guizhou", "广西": "guangxi", "云南": "yunnan", "山西": "shanxi", "陕西": "shaanxi", "甘肃": "gansu", "黑龙江": "heilongjiang",
    "吉林": "jilin", "内蒙古": "neimenggu", "青海": "qinghai", "宁夏": "ningxia", "海南": "hainan", "新疆": "xinjiang", "西藏": "xizang",
}
NATIONAL = {"新课标全国Ⅰ卷": "national_i", "新课标全国I卷": "national_i", "新课标全国Ⅱ卷": "national_ii", "新课标全国II卷": "national_ii", "全国甲卷": "national_a", "全国乙卷": "national_b"}
SUBJECTS = {
    "语文": "chinese", "数学": "math", "英语": "english", "物理": "physics", "化学": "chemistry", "生物": "biology", "政治": "politics", "历史": "history",
    "地理": "geography", "文综": "comprehensive_arts", "理综": "comprehensive_science",
}
# fixed values: the same for whole paths, where the subject stays in its own language
PATH_PROVINCES = "北京|上海|天津|重庆|河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海|台湾|内蒙古|广西|西藏|宁夏|新疆"
PATH_SUBJECTS = {"语文": "语文", "数学": "数学", "英语": "英语", "物理": "物理", "化学": "化学", "生物": "生物", "历史": "历史", "地理": "地理", "政治": "政治", "道德与法治": "政治", "文综": "文综", "理综": "理综"}
UNKNOWN = "未知"
# fixed values: signs of script injection
XSS = (r"(?i)<script\b[^<]*(?:(?!</script>)<[^<]*)*</script>", r"(?i)javascript:", r"(?i)on\w+\s*=", r"(?i)data:text/html", r"(?i)vbscript:", r"(?i)expression\s*\(")
# fixed values: answers that say nothing
TRIVIAL = ("请仔细观察题目条件", "思考题目的关键信息")
VALID_SUBJECTS = ("数学", "语文", "英语", "物理", "化学", "生物", "历史", "地理", "政治")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_think(text: Column) -> Column:
    """Without think blocks; a block whose end tag lacks its bracket stays."""
    return _trim(F.regexp_replace(text, r"(?s)<think.*?</think>", ""))


def strip_code(text: Column) -> Column:
    """Without code fences; what they hold stays."""
    return _trim(F.regexp_replace(F.regexp_replace(text, r"(?i)```json\s*", ""), r"```\s*", ""))


def unescape(text: Column) -> Column:
    """Written-out line ends, backslashes and quotes, in that order."""
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"'))


def is_json(text: Column) -> Column:
    """Whether text is one JSON value and nothing else. Spark's parser ignores what follows a value, so the text is parsed as the only element of
    an array and as the only member of an object: what ends one early can't end the other."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    return F.coalesce((F.size(alone) == 1) & member.isNotNull(), F.lit(False))


def _first_that_parses(*tries: Column) -> Column:
    return F.coalesce(*[F.when(is_json(t), t) for t in tries])


def _no_last_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def lenient_json(text: Column) -> Column:
    """The JSON in a model's answer as text: all of it, else from the first brace to the last, else that without commas before an end; null if none parses."""
    clean = strip_code(strip_think(text))
    braces = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    return _first_that_parses(clean, braces, _no_last_commas(braces))


def cjk_json(text: Column) -> Column:
    """From the first brace to the last, else that with ASCII quotes, commas and colons; null if neither parses."""
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return _first_that_parses(braces, F.translate(braces, "“”‘’，：", "\"\"'',:"))


def repaired_json(text: Column) -> Column:
    """JSON text as it is if it parses, else without last commas and with double quotes, else with lone backslashes doubled too."""
    quotes = F.regexp_replace(_no_last_commas(text), "'", '"')
    return _first_that_parses(text, quotes, F.regexp_replace(quotes, r'\\(?!"|\\|/|b|f|n|r|t|u)', r"\\\\"))


def json_array_elements(text: Column) -> Column:
    """The strings of a JSON array, and the ids of objects in it; a string or object alone is an array of one. What isn't JSON has none."""
    v = F.try_parse_json(F.when(is_json(text), F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))))
    kind = lambda x: F.schema_of_variant(x)
    each = F.transform(v.cast("array<variant>"), lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(kind(x).startswith("OBJECT"), F.try_variant_get(x, "$.id", "string")))
    return F.coalesce(F.filter(each, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def search_fields(data: Column) -> Column:
    """Lower-case texts of a question in which keywords are looked for: the fields of a JSON object in order of weight, and its keywords; other text as a whole."""
    fields = [F.get_json_object(data, f"$.{k}") for k in ("analysis", "solution", "clue", "metadata", "question", "subject")]
    words = F.array_join(F.from_json(F.get_json_object(data, "$.metadata.keywords"), "array<string>"), " ")
    found = F.filter(F.transform(F.array(*fields, words), lambda x: F.lower(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.when(is_json(data) & F.ltrim(data).startswith("{"), found), F.filter(F.array(F.lower(data)), lambda x: x.isNotNull()))


def keyword_match(fields: Column, keywords: list[str], core: set[str]) -> Column:
    """struct(score, matched, confidence) of a point's keywords (one at least): 2 for a core keyword that some field holds, 1 for another."""
    table = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(k.lower()).alias("low"), F.lit(2 if k in core else 1).alias("points")) for k in keywords])

    def held(texts: Column) -> Column:
        return F.filter(table, lambda k: F.exists(texts, lambda f: f.contains(k["low"])))

    def summed(hits: Column) -> Column:
        score = F.aggregate(hits, F.lit(0), lambda s, k: s + k["points"])
        return F.struct(score.alias("score"), F.transform(hits, lambda k: k["word"]).alias("matched"), (F.size(hits) / F.lit(float(len(keywords)))).alias("confidence"))

    # arrays of one, so that the fields and the hits are computed once
    return F.transform(F.transform(F.array(fields), held), summed)[0]


def _length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def image_quality(clue: Column, solution: Column, analysis: Column, has_metadata: Column, keywords: Column, difficulty: Column) -> Column:
    """0 to 100: 20 for each field of over 10 characters (10 for a shorter one), 10 each for metadata, keywords and a difficulty from 1 to 5, 20 if nothing is trivial."""
    fields = [clue, solution, analysis]
    score = reduce(lambda a, b: a + b, [F.when(_length(c) > 10, 20).when(_length(c) > 0, 10).otherwise(0) for c in fields])
    meta = F.coalesce(has_metadata, F.lit(False))
    score = score + F.when(meta, 10).otherwise(0) + F.when(meta & (F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0), 10).otherwise(0) + F.when(meta & difficulty.between(1, 5), 10).otherwise(0)
    trivial = reduce(lambda a, b: a | b, [(_length(c) < 5) | F.coalesce(c.isin(*TRIVIAL), F.lit(False)) for c in fields])
    return F.least(score + F.when(trivial, 0).otherwise(20), F.lit(100))


def explanation_quality(explanation: Column, key_points: Column, variants: Column, similar: Column) -> Column:
    """0 to 100: 30 for an explanation of over 20 characters (15 for a shorter one), 20 for each list that isn't empty, 10 for numbered steps."""
    some = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, 20).otherwise(0)
    score = F.when(_length(explanation) > 20, 30).when(_length(explanation) > 0, 15).otherwise(0)
    return F.least(score + some(key_points) + some(variants) + some(similar) + F.when(F.coalesce(explanation.rlike("步骤[1-9]"), F.lit(False)), 10).otherwise(0), F.lit(100))


def citations(text: Column) -> Column:
    """Numbers in [^N^], distinct and sorted as text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\^(\d+)\^\]"), F.lit(1))))


def entities(text: Column, most: int = 20) -> Column:
    """Bold names, distinct, the first ``most`` in order."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\*\*(.*?)\*\*"), F.lit(1)))), 1, most)


def without_tags(df: DataFrame) -> DataFrame:
    """All strings of a frame without markup tags, in structs and arrays too."""

    def clean(c: Column, t: DataType) -> Column:
        if isinstance(t, StringType):
            return F.regexp_replace(c, "<[^>]*>", "")
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def suspicious(text: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in XSS]), F.lit(False))


def validators(year_now: int) -> dict:
    """Checks by name; each takes a Column and is false for null."""
    between = lambda lo, hi: lambda c: c.between(lo, hi)
    return {
        "email": lambda c: c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
        "password": lambda c: F.length(c).between(6, 128),
        "question": lambda c: (F.length(_trim(c)) > 0) & (F.length(c) <= 5000),
        "subject": lambda c: c.isin(*VALID_SUBJECTS),
        "difficulty": between(1, 5),
        "score": between(0, 150),
        "year": between(2000, year_now + 1),
    }


def broken_rules(values: dict[str, Column], year_now: int, required: tuple[str, ...] = ()) -> Column:
    """Names of the rules that values break, sorted; a value that isn't ``required`` may be null."""
    rules = validators(year_now)
    checks = [F.when(~F.coalesce(rules[n](c), F.lit(n not in required)), F.lit(n)) for n, c in sorted(values.items())]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def vision_content(text: Column, formulas: Column) -> Column:
    """A question's text and, below it, its formulas."""
    block = F.when(F.size(F.coalesce(formulas, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n\n【公式】\n"), F.array_join(formulas, "\n"))).otherwise("")
    return _trim(F.concat(F.coalesce(text, F.lit("")), block))


def vector_text(vector: Column) -> Column:
    """[x,y,...] of a vector."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def vector_of(text: Column) -> Column:
    """The vector of [x,y,...]; null for other text."""
    return F.when(text.rlike(r"^\[\s*[-+.\deE,\s]*\]$"), F.from_json(text, "array<double>"))


ESSAY = ("content", "language", "structure", "development")


def essay_scores(answer: Column) -> Column:
    """struct of the four scores, their total and ``valid``: whole numbers from 0 to 20 each that add up to the total given."""
    s = F.from_json(F.get_json_object(answer, "$.metadata.scores"), "struct<" + ", ".join(f"{k}: double" for k in (*ESSAY, "total")) + ">")
    each = [s[k].between(0, 20) & (s[k] == F.floor(s[k])) for k in ESSAY]
    total = reduce(lambda a, b: a + b, [s[k] for k in ESSAY])
    return F.struct(*[s[k].cast("int").alias(k) for k in (*ESSAY, "total")], F.coalesce(reduce(lambda a, b: a & b, each) & (total == s["total"]), F.lit(False)).alias("valid"))


def _first_in(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(name.contains(k), F.lit(v)) for k, v in table.items()])


def detect_province(name: Column) -> Column:
    """Code of the first known province, or else national paper, in a file name."""
    return _first_in(name, PROVINCES | NATIONAL)


def detect_subject(name: Column) -> Column:
    return _first_in(name, SUBJECTS)


def detect_year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"20\d{2}", 0), F.lit("")).cast("int")


def path_metadata(path: Column) -> Column:
    """struct(stage, exam_type, doc_kind, province, subject, year) of a path; what it doesn't tell is unknown, a year 0."""
    name = F.element_at(F.split(path, "/"), -1)
    low = F.lower(path)
    high, middle = path.contains("高考") | low.contains("gaokao"), path.contains("中考") | low.contains("zhongkao")
    points = path.contains("知识点")
    stage = F.when(high, "高中").when(middle, "初中").otherwise(UNKNOWN)
    return F.struct(
        F.when(points & path.contains("高中"), "高中").otherwise(stage).alias("stage"),
        F.when(high, "高考").when(middle, "中考").otherwise(UNKNOWN).alias("exam_type"),
        F.when(points, "知识点").when(name.contains("解析") | name.contains("答案"), "解析版").when(name.contains("空白") | name.contains("原卷"), "原卷").otherwise("真题").alias("doc_kind"),
        F.coalesce(F.nullif(F.regexp_extract(path, PATH_PROVINCES, 0), F.lit("")), F.lit(UNKNOWN)).alias("province"),
        F.coalesce(_first_in(path, PATH_SUBJECTS), F.lit(UNKNOWN)).alias("subject"),
        F.coalesce(F.nullif(F.regexp_extract(name, r"(19|20)\d{2}", 0), F.lit("")).cast("int"), F.lit(0)).alias("year"),
    )


# fixed values: how provinces combine subjects, which they do, and the subjects of each combination
COMMON = ("chinese", "math", "english")
MODELS = {
    "3+1+2": "hebei liaoning jiangsu fujian hubei hunan guangdong chongqing anhui jiangxi henan shanxi sichuan yunnan guangxi guizhou gansu heilongjiang jilin".split(),
    "3+3": "beijing shanghai tianjin zhejiang shandong hainan".split(),
}
SHORT = {"chem": "chemistry", "bio": "biology", "geo": "geography", "pol": "politics", "hist": "history"}
COMBINATIONS = {
    "3+1+2": "physics-chem-bio physics-chem-geo physics-chem-pol physics-bio-geo physics-bio-pol physics-geo-pol history-chem-bio history-chem-geo history-chem-pol history-bio-geo history-bio-pol history-geo-pol".split(),
    "3+3": """physics-chem-bio physics-chem-geo physics-chem-hist physics-bio-geo physics-bio-hist physics-bio-pol physics-geo-hist physics-geo-pol physics-hist-pol chem-bio-geo
        chem-bio-hist chem-bio-pol bio-geo-hist bio-geo-pol bio-hist-pol geo-hist-pol chem-geo-hist chem-geo-pol chem-hist-pol geo-hist-pol-2""".split(),
}
TRADITIONAL = {"science": ("physics", "chemistry", "biology"), "liberal": ("politics", "history", "geography")}


def combination_subjects() -> dict[str, list[str]]:
    """All subjects of each combination; an id names what is chosen."""
    named = {i: [SHORT.get(x, x) for x in i.split("-") if not x.isdigit()] for ids in COMBINATIONS.values() for i in ids}
    return {i: [*COMMON, *s] for i, s in (named | {k: list(v) for k, v in TRADITIONAL.items()}).items()}


def _lookup(table: dict[str, Column], key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, v) for k, v in table.items()])


def exam_model(province: Column) -> Column:
    """How a province combines subjects; traditionally where it isn't listed."""
    return F.coalesce(*[F.when(province.isin(p), F.lit(m)) for m, p in MODELS.items()], F.lit("traditional"))


def subjects_of(combination: Column) -> Column:
    """All subjects of a combination; null for an unknown one."""
    return _lookup({i: F.array(*map(F.lit, s)) for i, s in combination_subjects().items()}, combination)


def select_index(subject: Column, province: Column, level: Column) -> Column:
    """The document index for a question; the first rule that fits."""
    return (
        F.when((level == "中考") & (province == "北京"), "zhongkao_beijing").when(subject == "数学", "subject_math").when(subject == "语文", "subject_chinese")
        .when((province == "北京") & (level == "高考"), "province_beijing").when(level == "中考", "zhongkao_beijing").otherwise("gaokao_all")
    )


def tutor_stream(stream: Column) -> Column:
    """struct(metadata, content, state) of a tutor's server-sent events: the metadata event's data, all content data joined, and done, error or open."""
    blocks = F.filter(F.split(stream, r"\n\n"), lambda b: F.trim(b) != "")
    name = lambda b: F.trim(F.regexp_extract(b, r"(?m)^event:(.*)$", 1))
    data = lambda b: F.trim(F.regexp_extract(b, r"(?m)^data:(.*)$", 1))
    of = lambda n: F.filter(blocks, lambda b: name(b) == n)
    text = F.transform(of("content"), lambda b: F.coalesce(F.get_json_object(data(b), "$.content"), F.get_json_object(data(b), "$"), data(b)))
    return F.struct(
        data(F.try_element_at(of("metadata"), F.lit(1))).alias("metadata"),
        F.array_join(text, "").alias("content"),
        F.when(F.size(of("error")) > 0, "error").when(F.size(of("done")) > 0, "done").otherwise("open").alias("state"),
    )
