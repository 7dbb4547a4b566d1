"""Small text rules and row checks over the given tables, one query each.

Texts that the rules are about (titles, questions, replies in Korean) aren't given, so the queries build them from
columns of the given tables; rules themselves are in ``millrace.functions.text``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query, table


@query(r"""
    WITH c AS (SELECT p_partkey, upper(substring(p_type, 1, 1)) || p_size || 'O' AS code FROM part),
    v AS (
        SELECT p_partkey, unnest(list_concat([code], list_transform(range(1, length(code) + 1), lambda i: substring(code, 1, i - 1) || translate(substring(code, i, 1), 'O0I1S5B8', '0O1I5S8B') || substring(code, i + 1)))) AS variant
        FROM c
    )
    SELECT p_partkey, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM v GROUP BY p_partkey
""")
def fn2_code_variants(spark, sf_dir):
    code = T.normalize_code(F.concat(F.substring("p_type", 1, 1), F.col("p_size"), F.lit("-O")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.code_variants(code), ",").alias("variants"))


QUESTIONS = """
    q AS (
        SELECT event_id AS q_id, user_id, 'Brand#' || (user_id % 25) AS brand, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][event_id % 6 + 1] AS category,
            CASE event_id % 4 WHEN 0 THEN event_type || ' shows E0' || (event_id % 60) || ' today' WHEN 1 THEN 'FF/' || event_type || ' dE'
                WHEN 2 THEN event_type || ' E' || (event_id % 45) || ', E' || (user_id % 45) || ' again' ELSE event_type || ' without anything' END AS text
        FROM events
    )
"""
#: The tokens of a question that are codes as a whole; its separators are blanks, commas and slashes only.
CODES_OF_QUESTIONS = QUESTIONS + r""",
    tok AS (SELECT q_id, brand, category, unnest(string_split_regex(text, '[ ,/]+')) AS token, generate_subscripts(string_split_regex(text, '[ ,/]+'), 1) AS pos FROM q),
    cod AS (
        SELECT q_id, brand, category, pos, regexp_replace(upper(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')), '^([A-Z]*)0+([0-9]+[A-Z]*)$', '\1\2') AS code
        FROM tok WHERE regexp_full_match(token, '[A-Za-z]{1,3}\s?-?\d{1,3}|\d[A-Za-z]{1,2}|[A-Z][A-Za-z]{1,2}|[a-z][A-Z]{1,2}')
    )
"""


def questions(spark, sf_dir):
    """(q_id, user_id, brand, category, text)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS q_id",
        "user_id",
        "concat('Brand#', user_id % 25) AS brand",
        "element_at(array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), cast(event_id % 6 + 1 AS int)) AS category",
        """CASE event_id % 4 WHEN 0 THEN concat(event_type, ' shows E0', event_id % 60, ' today') WHEN 1 THEN concat('FF/', event_type, ' dE')
        WHEN 2 THEN concat(event_type, ' E', event_id % 45, ', E', user_id % 45, ' again') ELSE concat(event_type, ' without anything') END AS text""",
    )


@query("WITH " + CODES_OF_QUESTIONS + """
    , f AS (SELECT q_id, code, min(pos) AS pos FROM cod GROUP BY ALL)
    SELECT q.q_id, coalesce(string_agg(code, ',' ORDER BY pos), '') AS codes FROM q LEFT JOIN f USING (q_id) GROUP BY ALL
""")
def fn3_query_codes(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.codes_in(F.col("text")), ",").alias("codes"))


@query(r"""
    WITH s AS (SELECT p_partkey, unnest(['P' || p_size, 'CH0' || p_size, 'x' || p_size || 'y', '제품' || p_size]) AS token, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM part),
    c AS (SELECT p_partkey, pos, regexp_replace(token, '^([A-Z]*)0+([0-9]+)$', '\1\2') AS code FROM s WHERE regexp_full_match(token, '[A-Za-z]{1,3}\d{1,3}'))
    SELECT p_partkey, string_agg(code, ',' ORDER BY pos) AS codes FROM c GROUP BY p_partkey
""")
def fn7_summary_codes(spark, sf_dir):
    size = F.col("p_size")
    summary = F.concat(F.lit("P"), size, F.lit("/CH0"), size, F.lit("/x"), size, F.lit("y/제품"), size)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.summary_codes(summary), ",").alias("codes"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' (' || p_name || ')' ELSE 'E' || p_size || '|' || p_type END AS codes,
        CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' (' || p_name || ')' ELSE '통신 ' || p_name END AS description FROM part
""")
def fn8_described_codes(spark, sf_dir):
    title = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' (', p_name, ')') ELSE concat('E', p_size, ' / ', p_type, ' (통신 ', p_name, ') (', p_brand, ')') END")
    rows = table(spark, sf_dir, "part").select("p_partkey", T.described_codes(title).alias("d"))
    return rows.select("p_partkey", F.array_join("d.codes", "|").alias("codes"), "d.description")


@query("""
    SELECT page_id, CASE WHEN contains(path, '_') THEN substring(path, position('_' IN path) + 1) ELSE path END AS model
    FROM (SELECT page_id, upper(replace(url, '/', '_')) AS path FROM pages)
""")
def fn11_models_of_paths(spark, sf_dir):
    """The text of a file name after its first underscore."""
    path = F.upper(F.replace("url", F.lit("/"), F.lit("_")))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "^[^_]*_", "").alias("model"))


@query(r"""
    SELECT p_partkey, regexp_replace(' ' || p_name || '  care ', '\s+', '', 'g') AS feature, lower(regexp_replace(p_brand || ' ' || p_type, '\s+', '', 'g')) AS alias FROM part
""")
def fn12_features(spark, sf_dir):
    blank = lambda x: F.regexp_replace(x, r"\s+", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        blank(F.concat(F.lit(" "), "p_name", F.lit("  care "))).alias("feature"),
        F.lower(blank(F.concat_ws(" ", "p_brand", "p_type"))).alias("alias"),
    )


@query(r"""
    WITH s AS (SELECT event_id, text, trim(regexp_replace(replace(replace(text, 'FQ18' || (event_id % 7), ''), 'FQ18', ''), ' +', ' ', 'g')) AS rest
        FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'FQ18' ELSE 'the FQ18' || (event_id % 7) || ' ' || event_type || ' FQ18 now' END AS text FROM events))
    SELECT event_id, CASE WHEN rest = '' THEN text ELSE rest END AS text FROM s
""")
def fn13_without_models(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 5 = 0 THEN 'FQ18' ELSE concat('the FQ18', event_id % 7, ' ', event_type, ' FQ18 now') END AS text",
        "array('FQ18', concat('FQ18', event_id % 7)) AS names",
    )
    return rows.select("event_id", T.without_names(F.col("text"), F.col("names")).alias("text"))


@query("""
    SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: NOT regexp_full_match(x, '[0-9A-Za-z]{1,2}')), '')) AS gram_text_md5
    FROM documents WHERE text IS NOT NULL
""")
def fn15_gram_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.gram_text(F.col("text"))).alias("gram_text_md5"))


#: Phrases about actions, with the side of each opposite pair that they are on.
PHRASES = ["전원을 끄세요", "전원을 켜세요", "필터를 분리해요", "필터를 끼우세요", "문을 열어요", "문을 닫아요", "온도를 올려요", "온도를 낮추게", "손잡이를 당겨요", "손잡이를 밀어요", "끄고 켜세요", "확인하세요"]


@query(f"""
    WITH p AS (SELECT p_partkey, {PHRASES!r}[p_partkey % 12 + 1] AS a, {PHRASES!r}[p_size % 12 + 1] AS b FROM part),
    r AS (SELECT unnest({[x for x, _ in T.OPPOSITES]!r}) AS x, unnest({[y for _, y in T.OPPOSITES]!r}) AS y),
    m AS (SELECT p.*, regexp_matches(a, x) AS ax, regexp_matches(a, y) AS ay, regexp_matches(b, x) AS bx, regexp_matches(b, y) AS "by" FROM p, r)
    SELECT p_partkey, bool_or((ax AND NOT ay AND "by" AND NOT bx) OR (ay AND NOT ax AND bx AND NOT "by")) AS opposed FROM m GROUP BY p_partkey
""")
def fn18_opposite_actions(spark, sf_dir):
    phrase = lambda n: F.element_at(F.array(*map(F.lit, PHRASES)), (n % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.opposed(phrase(F.col("p_partkey")), phrase(F.col("p_size"))).alias("opposed"))


@query(r"""
    WITH l AS (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
    ), m AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN ' ' || (line_no + 1) || ') **' || line || '**' WHEN 1 THEN '• ' || line ELSE line END AS line FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(regexp_replace(replace(line, '**', ''), '^\s*(\d+[.)]|[-•*])\s*', '')) AS step_md5 FROM m
""")
def fn19_step_texts(spark, sf_dir):
    from millrace.operators import chunking

    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", "line")
    marked = F.expr("CASE line_no % 3 WHEN 0 THEN concat(' ', line_no + 1, ') **', line, '**') WHEN 1 THEN concat('• ', line) ELSE line END")
    return rows.select("doc_id", "line_no", F.md5(T.step_text(marked)).alias("step_md5"))


@query(r"""
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(trim(q, E' \t\n\r'), '^["''“”‘’]+|["''“”‘’]+$', '', 'g'), '\s+', ' ', 'g')) AS quote_md5
    FROM (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN ' “' || text || '” ' ELSE '"' || text || '''' END AS q FROM conversations WHERE text IS NOT NULL)
""")
def fn22_quotes(spark, sf_dir):
    quote = F.expr("""CASE turn % 2 WHEN 0 THEN concat(' “', text, '” ') ELSE concat('"', text, "'") END""")
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(T.quote_text(quote)).alias("quote_md5"))


@query("""
    SELECT c_custkey, concat_ws(' ', CASE c_custkey % 3 WHEN 0 THEN 'LG' WHEN 1 THEN '삼성' ELSE nullif(c_mktsegment, '') END,
        nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(upper(c_name), '')) AS label FROM customer
""")
def fn23_appliance_labels(spark, sf_dir):
    """Brand in the language of the labels, type and model, those that aren't empty."""
    brand = F.expr("element_at(map(0, 'lg', 1, 'samsung'), cast(c_custkey % 3 AS int))")
    named = F.coalesce(F.element_at(F.create_map(F.lit("lg"), F.lit("LG"), F.lit("samsung"), F.lit("삼성")), brand), F.col("c_mktsegment"))
    kind = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    parts = [F.nullif(x, F.lit("")) for x in (named, kind, F.upper("c_name"))]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", *parts).alias("label"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'YES' WHEN event_id % 3 = 1 THEN 'PARSE_ERROR' ELSE 'NO' END AS label,
        CASE WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS quote, CASE WHEN event_id % 3 = 0 THEN 'user ' || user_id || ' | more' ELSE '' END AS reason FROM events
""")
def fn26_verdicts(spark, sf_dir):
    reply = F.expr("CASE event_id % 3 WHEN 0 THEN concat(' yes |', event_type, '| user ', user_id, ' | more ') WHEN 1 THEN concat('maybe ', event_type) ELSE concat('NO | ', event_type) END")
    return table(spark, sf_dir, "events").select("event_id", T.verdict(reply, ("YES", "NO")).alias("v")).select("event_id", "v.label", "v.quote", "v.reason")


@query(r"""
    WITH u AS (SELECT event_id, event_type || ' of user ' || user_id AS question, event_type AS feature, CASE event_id % 3 WHEN 0 THEN 'OF  User' WHEN 1 THEN '' ELSE 'absent' END AS evidence,
        CASE event_id % 2 WHEN 0 THEN 'user ' || user_id ELSE 'fridge' END AS other FROM events),
    n AS (SELECT *, lower(regexp_replace(question, '\s+', '', 'g')) AS qn, lower(regexp_replace(evidence, '\s+', '', 'g')) AS en, lower(regexp_replace(other, '\s+', '', 'g')) AS o FROM u)
    SELECT event_id, CASE WHEN feature IN ('view', 'click', 'error') AND evidence <> '' AND contains(qn, en) THEN feature END AS feature, CASE WHEN contains(qn, o) THEN other END AS other_product FROM n
""")
def fn27_validated(spark, sf_dir):
    """A model's reading of a question: only known features with evidence, and products, that the question names."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat(event_type, ' of user ', user_id) AS question",
        "event_type AS feature",
        "CASE event_id % 3 WHEN 0 THEN 'OF  User' WHEN 1 THEN '' ELSE 'absent' END AS evidence",
        "CASE event_id % 2 WHEN 0 THEN concat('user ', user_id) ELSE 'fridge' END AS other",
    )
    question = plain(F.col("question"))
    sure = F.col("feature").isin("view", "click", "error") & (F.col("evidence") != "") & F.contains(question, plain(F.col("evidence")))
    return rows.select("event_id", F.when(sure, F.col("feature")).alias("feature"), F.when(F.contains(question, plain(F.col("other"))), F.col("other")).alias("other_product"))


@query("SELECT c_custkey, sha256('millrace::' || c_name) AS hash FROM customer")
def fn29_password_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("millrace::"), "c_name"), 256).alias("hash"))


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' WHEN 2 THEN '.jpg' ELSE '.bin' END AS ext FROM pages
""")
def fn30_content_types(spark, sf_dir):
    """The type of a file by its first bytes."""
    first = F.expr("CASE page_id % 4 WHEN 0 THEN unhex('89504E470D0A1A0A') WHEN 1 THEN unhex('474946383961') WHEN 2 THEN unhex('FFD8FFE0') ELSE unhex('00') END")
    content = F.concat(first, F.col("html").cast("binary"))
    starts = lambda n, digits: F.hex(F.substring(content, 1, n)) == digits
    kind = F.when(starts(8, "89504E470D0A1A0A"), ".png").when(starts(3, "FFD8FF"), ".jpg").when(starts(4, "47494638"), ".gif").otherwise(".bin")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("ext"))


@query("""
    SELECT doc_id, NOT regexp_matches(coalesce(t, ''), '[가-힣]') AS no_hangul, NOT regexp_matches(coalesce(t, ''), '[A-Za-z]') AS no_latin, regexp_full_match(trim(coalesce(t, '')), '[0-9]+') AS digits_only
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' || doc_id || ' ' WHEN 1 THEN text || '냉장고' ELSE text END AS t FROM documents)
""")
def fn32_scripts(spark, sf_dir):
    text = F.coalesce(F.expr("CASE doc_id % 3 WHEN 0 THEN concat(' ', doc_id, ' ') WHEN 1 THEN concat(text, '냉장고') ELSE text END"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", (~text.rlike("[가-힣]")).alias("no_hangul"), (~text.rlike("[A-Za-z]")).alias("no_latin"), F.trim(text).rlike("^[0-9]+$").alias("digits_only"))


@query(r"""
    SELECT p_partkey, regexp_replace('[' || p_brand || '] ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' [x]' ELSE '' END, '^\s*\[[^\]]*\]\s*', '') AS title,
        array_to_string(regexp_extract_all(string_split(p_type || ',' || p_type || '1/tCL [' || p_name || ']', '[')[1], '[A-Za-z0-9]+'), ',') AS tokens FROM part
""")
def fn36_titles_and_tokens(spark, sf_dir):
    """Titles without the bracket before them; the tokens of a code label before its bracket (FN-37)."""
    title = F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", F.expr("CASE WHEN p_partkey % 2 = 0 THEN ' [x]' ELSE '' END"))
    label = F.concat("p_type", F.lit(","), "p_type", F.lit("1/tCL ["), "p_name", F.lit("]"))
    tokens = F.regexp_extract_all(F.substring_index(label, "[", 1), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(title, r"^\s*\[[^\]]*\]\s*", "").alias("title"), F.array_join(tokens, ",").alias("tokens"))


@query(r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(E' ' || p_name || E' \n ' || p_type || '• ' || p_brand || E' \n•' || p_size), '\s*\n\s*', ' ', 'g'), '\s*•\s*', E'\n• ', 'g')) AS cell,
        regexp_replace(' ' || p_name || chr(65279), '\s+|' || chr(65279), '', 'g') AS header FROM part
""")
def fn39_cells(spark, sf_dir):
    cell = F.concat(F.lit(" "), "p_name", F.lit(" \n "), "p_type", F.lit("• "), "p_brand", F.lit(" \n•"), F.col("p_size"))
    header = F.regexp_replace(F.concat(F.lit(" "), "p_name", F.lit("\ufeff")), "\\s+|\ufeff", "")
    return table(spark, sf_dir, "part").select("p_partkey", T.cell_text(cell).alias("cell"), header.alias("header"))


@query(r"""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || ' (' || p_type || ')|' || p_name ELSE '(' || p_type || ')' END AS variants FROM part
""")
def fn40_title_variants(spark, sf_dir):
    title = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' (', p_type, ') ') ELSE concat('(', p_type, ')') END")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.title_variants(title), "|").alias("variants"))


@query("""
    SELECT doc_id, md5('[' || source || ' / ' || lang || ' / ' || doc_id || '] ' || text) AS document_md5, source AS name, length(text) AS n_chars FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL
""")
def fn41_document_headers(spark, sf_dir):
    """A document's text behind a header of its name, type and title, with the metadata that goes into the index."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    header = F.concat(F.lit("["), F.concat_ws(" / ", "source", "lang", F.col("doc_id")), F.lit("] "), F.col("text"))
    return docs.select("doc_id", F.md5(header).alias("document_md5"), F.col("source").alias("name"), F.length("text").cast("long").alias("n_chars"))


@query("""
    SELECT event_id, md5('{"query":"' || event_type || '","user":' || user_id || ',"features":["a","b"],"version":3}') AS key FROM events
""")
def fn42_cache_keys(spark, sf_dir):
    parts = F.struct(F.col("event_type").alias("query"), F.col("user_id").alias("user"), F.array(F.lit("a"), F.lit("b")).alias("features"), F.lit(3).alias("version"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(F.to_json(parts)).alias("key"))


# Row checks ----------------------------------------------------------------------------------------------------------
#: What a question is about, in order.
TROUBLE = r"(에러|오류|고장|이상)\s*(메시지|코드|증상)?\s*.{0,6}(확인|어디)"
SYMPTOM = r"(소리|소음|냄새|성에|진동|누수|물)\s*.{0,10}(나요|나는데|그래요|생겨요)|(안\s*(돼요|되요|열려요|닫혀요|켜져요|나와요))"
PANEL = r"(온도|기능|모드)\s*.{0,6}(설정|조절|선택)\s*.{0,6}(방법|어떻게)"
SPEC = r"(전력|소비|효율|등급|사용량|무게|용량|크기|사이즈)\s*.{0,10}(궁금|어떻게|얼마)|얼마나\s*넣"
FEATURE = r"(기능|모드|코스)\s*.{0,4}(이|가|은|는)?\s*(뭐야|뭐예요|무엇|알려줘|어떻게 써|어떻게 되나요)"
#: Fixed value: signs of danger in a question.
HAZARD = (
    r"타는|탄\s*내|연기|불꽃|불이\s*(나|났|붙)|불나|화재|발화|스파크|폭발|과열|감전|찌릿|누전|합선|(가스|냉매)\s*(냄새|샌|새|누출)|"
    r"젖은|물이\s*(들어|튀|닿|샜|새)|침수|물에\s*(젖|잠)|(전원선|전원\s*코드|플러그)[^.?!]{0,8}(손상|벗겨|녹|뜨겁|뜨거|피복)"
)
#: Fixed value: words of a safety chapter's body.
SAFETY = ["화재", "감전", "가스", "누전", "상해나 사망", "인체에 해롭", "스파크"]
ASKED = ["에러 코드 확인하는 방법", "소리가 크게 나요", "문이 안 열려요", "온도 설정하는 방법", "소비 전력이 얼마예요", "세제를 얼마나 넣어요", "무풍 기능이 뭐야", "불이 안 켜져요", "플러그가 뜨거워요", "가스 냄새가 나요", "안녕하세요"]


@query(rf"""
    WITH q AS (SELECT event_id, {ASKED!r}[event_id % 11 + 1] || ' ' || user_id AS text FROM events)
    SELECT event_id, CASE WHEN regexp_matches(text, '{TROUBLE}') OR regexp_matches(text, '{SYMPTOM}') THEN 'TROUBLESHOOTING' WHEN regexp_matches(text, '{PANEL}') THEN 'PROCEDURE'
        WHEN regexp_matches(text, '{SPEC}') THEN 'SPEC' WHEN regexp_matches(text, '{FEATURE}') THEN 'FEATURE_EXPLANATION' END AS content_type FROM q
""")
def flt8_intents(spark, sf_dir):
    text = F.concat(F.element_at(F.array(*map(F.lit, ASKED)), (F.col("event_id") % 11 + 1).cast("int")), F.lit(" "), "user_id")
    kind = F.when(text.rlike(TROUBLE) | text.rlike(SYMPTOM), "TROUBLESHOOTING").when(text.rlike(PANEL), "PROCEDURE").when(text.rlike(SPEC), "SPEC").when(text.rlike(FEATURE), "FEATURE_EXPLANATION")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("content_type"))


@query(rf"""
    WITH q AS (SELECT user_id, event_id, {ASKED!r}[event_id % 11 + 1] AS text, event_type FROM events), s AS (SELECT user_id, bool_or(event_type = 'error') AS used FROM q GROUP BY user_id)
    SELECT event_id, used AND regexp_matches(text, '{HAZARD}') AS warned FROM q JOIN s USING (user_id)
""")
def flt13_hazards(spark, sf_dir):
    """A safety warning only where a question has a sign of danger and a chunk that was used is a safety one."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    used = rows.groupBy("user_id").agg(F.max(F.col("event_type") == "error").alias("used"))
    text = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("event_id") % 11 + 1).cast("int"))
    return rows.join(used, "user_id").select("event_id", (F.col("used") & text.rlike(HAZARD)).alias("warned"))


@query(rf"""
    WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '고장 신고 전' WHEN 1 THEN p_type ELSE '확인하기' END AS heading, p_name || ' ' || {[*SAFETY, '사용', '청소', '보관']!r}[p_size % 10 + 1] AS body FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(body, '{'|'.join(SAFETY)}') THEN 'safety' WHEN contains(heading, '고장') OR contains(heading, '확인하기') THEN 'symptom' ELSE 'howto' END AS tag FROM c
""")
def flt14_tags(spark, sf_dir):
    words = F.array(*map(F.lit, [*SAFETY, "사용", "청소", "보관"]))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '고장 신고 전' WHEN 1 THEN p_type ELSE '확인하기' END").alias("heading"),
        F.concat("p_name", F.lit(" "), F.element_at(words, (F.col("p_size") % 10 + 1).cast("int"))).alias("body"),
    )
    safe = F.col("body").rlike("|".join(SAFETY))
    tag = F.when(safe, "safety").when(F.contains("heading", F.lit("고장")) | F.contains("heading", F.lit("확인하기")), "symptom").otherwise("howto")
    return rows.select("p_partkey", tag.alias("tag"))


BASES = list(T.CHAPTERS)


@query(f"""
    WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {BASES!r}[p_size % 11 + 1] WHEN 1 THEN ' ' || {BASES!r}[p_size % 11 + 1] || ' - ' || p_name || ' ' WHEN 2 THEN {BASES!r}[p_size % 11 + 1] || '-' || p_name ELSE p_name END AS title FROM part)
    SELECT p_partkey, (SELECT b FROM (SELECT unnest({BASES!r}) AS b) WHERE trim(title) = b OR starts_with(trim(title), b || ' - ')) AS base FROM t
""")
def flt21_chapter_bases(spark, sf_dir):
    """The base of a chapter's title: the title is the base, or goes on with a dash; the first base wins."""
    base = F.element_at(F.array(*map(F.lit, BASES)), (F.col("p_size") % 11 + 1).cast("int"))
    title = F.when(F.col("p_partkey") % 4 == 0, base).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" "), base, F.lit(" - "), "p_name", F.lit(" ")))
    title = F.trim(title.when(F.col("p_partkey") % 4 == 2, F.concat(base, F.lit("-"), "p_name")).otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", T.chapter_of(title).alias("base"))


@query("""
    SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0 THEN CASE WHEN starts_with(upper(model), 'T') THEN 'top' ELSE 'drum' END END AS variant,
        NOT coalesce(c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0 AND picture IN ('drum', 'top') AND picture <> CASE WHEN starts_with(upper(model), 'T') THEN 'top' ELSE 'drum' END, false) AS shown
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 't' ELSE 'F' END || c_custkey AS model, CASE c_custkey % 5 WHEN 0 THEN 'drum' WHEN 1 THEN 'top' WHEN 2 THEN 'both' END AS picture FROM customer)
""")
def flt19_picture_variants(spark, sf_dir):
    """Washers of one brand have pictures for two kinds, told apart by the model's first letter; others show all."""
    model = F.concat(F.when(F.col("c_custkey") % 3 == 0, "t").otherwise("F"), "c_custkey")
    picture = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'drum' WHEN 1 THEN 'top' WHEN 2 THEN 'both' END")
    washer = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") % 2 == 0)
    wanted = F.when(washer, F.when(F.startswith(F.upper(model), F.lit("T")), "top").otherwise("drum"))
    hidden = wanted.isNotNull() & picture.isin("drum", "top") & (picture != wanted)
    return table(spark, sf_dir, "customer").select("c_custkey", wanted.alias("variant"), (~F.coalesce(hidden, F.lit(False))).alias("shown"))


@query("""
    SELECT 'status' AS rule, o_orderkey AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'priority', o_orderkey FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-.*')
    UNION ALL SELECT 'customer', o_orderkey FROM orders WHERE o_custkey % 7 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'quantity', l_orderkey FROM lineitem WHERE NOT l_quantity BETWEEN 2 AND 50
""")
def flt10_violations(spark, sf_dir):
    """Rows that break a rule of the tables: values outside an enumeration or a range, keys without their row."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    found = lambda rows, rule, key: rows.select(F.lit(rule).alias("rule"), F.col(key).alias("id"))
    parts = [
        found(orders.where(~F.col("o_orderstatus").isin("F", "O")), "status", "o_orderkey"),
        found(orders.where(~F.col("o_orderpriority").rlike("^[1-5]-.*$")), "priority", "o_orderkey"),
        found(orders.where("o_custkey % 7 = 0").join(owners, "o_custkey", "left_anti"), "customer", "o_orderkey"),
        found(line.where("NOT l_quantity BETWEEN 2 AND 50"), "quantity", "l_orderkey"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
