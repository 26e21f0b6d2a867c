"""Queries over answer strings: extraction, parsing, typed verification, actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tables, text
from .registry import query
from .views import ANSWERS, NUMBERS, answers, numbers, table


def _distinct(spark, d):
    return answers(spark, d).select("raw", "reference").distinct()


_PAIRS = f"WITH {ANSWERS}, v AS (SELECT DISTINCT q, n FROM answers)"
_D = f"WITH {ANSWERS}, v AS (SELECT DISTINCT raw, reference FROM answers)"


@query("extract_final_tag", f"""{_D}, t AS (SELECT *, regexp_extract_all(raw, '(?s)<final>(.*?)</final>', 1) AS tags FROM v),
j AS (SELECT *, CASE WHEN len(tags) = 1 AND json_valid(tags[1]) THEN tags[1] END AS js FROM t)
SELECT raw, reference, CASE WHEN len(tags) > 1 THEN 'ambiguous' WHEN json_type(js, '$.answer') = 'VARCHAR' THEN 'ok' ELSE 'missing' END AS status, CASE WHEN len(tags) = 1 THEN json_extract_string(js, '$.answer') END AS value FROM j""")
def _(spark, d):
    return _distinct(spark, d).withColumn("t", A.final_tag(F.col("raw"))).select("raw", "reference", "t.status", "t.value")


_STRICT = f"""{_D}, t AS (SELECT *, regexp_extract_all(raw, '(?s)<final>(.*?)</final>', 1) AS tags FROM v),
j AS (SELECT *, CASE WHEN len(tags) = 1 AND json_valid(tags[1]) THEN tags[1] END AS js FROM t),
s AS (SELECT raw, reference, CASE WHEN contains(raw, '<final>') THEN CASE WHEN len(tags) > 1 THEN 'ambiguous' WHEN json_type(js, '$.answer') = 'VARCHAR' THEN 'ok' ELSE 'missing' END WHEN raw LIKE '\\boxed%' OR raw LIKE '$%$' THEN 'ok' ELSE 'missing' END AS status,
  CASE WHEN contains(raw, '<final>') THEN CASE WHEN len(tags) = 1 THEN json_extract_string(js, '$.answer') END WHEN raw LIKE '\\boxed%' THEN regexp_extract(raw, '\\{{(.*)\\}}', 1) WHEN raw LIKE '$%$' THEN regexp_extract(raw, '\\$(.*)\\$', 1) END AS value FROM j)"""


def _strict(df):
    return df.withColumn("x", A.strict(F.col("raw"))).select(*df.columns, "x.status", "x.value")


@query("extract_strict", f"{_STRICT} SELECT * FROM s")
def _(spark, d):
    return _strict(_distinct(spark, d))


@query("prediction_rows", f"""{_STRICT} SELECT raw, reference, status AS extract_status, value AS prediction,
 CASE WHEN status <> 'ok' THEN 'missing' WHEN NOT regexp_full_match(value, '[+-]?\\d+') THEN 'invalid_prediction' WHEN CAST(value AS BIGINT) = CAST(reference AS BIGINT) THEN 'correct' ELSE 'incorrect' END AS verifier_status FROM s""")
def _(spark, d):
    s = _strict(_distinct(spark, d))
    verdict = F.when(F.col("status") != "ok", F.lit("missing")).otherwise(A.native_status(F.col("value"), F.col("reference"), "integer"))
    return s.select("raw", "reference", F.col("status").alias("extract_status"), F.col("value").alias("prediction"), verdict.alias("verifier_status"))


@query("boxed_scan", f"{_D} SELECT raw, CASE WHEN raw LIKE '\\boxed%' THEN [regexp_extract(raw, '\\{{(.*)\\}}', 1)] ELSE CAST([] AS VARCHAR[]) END AS groups FROM v")
def _(spark, d):
    scan = F.pandas_udf(lambda x: x.map(A.boxed), "array<string>")
    return _distinct(spark, d).select("raw", scan("raw").alias("groups"))


@query("dollar_groups", f"{_D} SELECT DISTINCT raw, list_filter(list_transform(regexp_extract_all(raw, '(?s)\\\\\\$|\\$(.*?)\\$', 1), lambda x: trim(x)), lambda x: x <> '') AS groups FROM v")
def _(spark, d):
    return _distinct(spark, d).select("raw").distinct().select("raw", A.dollar_spans(F.col("raw")).alias("groups"))


@query("boxed_groups_table", f"""WITH {ANSWERS}, v AS (SELECT DISTINCT q, n FROM answers)
SELECT q, n, 0 AS place, CAST(q AS VARCHAR) AS value FROM v UNION ALL SELECT q, n, 1, '\\frac{{' || q || '}}{{' || n || '}}' FROM v WHERE n % 2 = 0 UNION ALL SELECT q, n, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END, CAST(n AS VARCHAR) FROM v""")
def _(spark, d):
    """One row for each boxed group, through the table function in SQL."""
    tables.register_all(spark)
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    nested = F.when(F.col("n") % 2 == 0, F.concat(F.lit(" or \\boxed{\\frac{"), q, F.lit("}{"), n, F.lit("}}"))).otherwise(F.lit(" or \\boxed{"))
    texts = answers(spark, d).select("q", "n").distinct().select("q", "n", F.concat(F.lit("\\boxed{"), q, F.lit("}"), F.when(F.col("n") % 2 == 0, nested).otherwise(F.lit("")), F.lit(" and \\\\boxed {"), n, F.lit("}")).alias("raw"))
    return spark.sql("SELECT q, n, place, value FROM {texts}, LATERAL answer_groups(raw, 'boxed')", texts=texts)


@query("nested_items_table", f"""{_PAIRS}, i AS (
  SELECT q, n, '' AS path, 0 AS depth, 'tuple' AS kind, '({{' || CASE WHEN q = n THEN CAST(q AS VARCHAR) ELSE least(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) || ', ' || greatest(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) END || '}}, ' || n || ')' AS value FROM v
  UNION ALL SELECT q, n, '0', 1, 'set', '{{' || CASE WHEN q = n THEN CAST(q AS VARCHAR) ELSE least(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) || ', ' || greatest(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) END || '}}' FROM v
  UNION ALL SELECT q, n, '0.0', 2, 'number', CAST(q AS VARCHAR) FROM v UNION ALL SELECT q, n, '0.1', 2, 'number', CAST(n AS VARCHAR) FROM v UNION ALL SELECT q, n, '1', 1, 'number', CAST(n AS VARCHAR) FROM v)
SELECT * FROM i""")
def _(spark, d):
    """A tuple of a set and a number, item by item, through the table function in SQL."""
    tables.register_all(spark)
    texts = _pairs(spark, d).select("q", "n", F.format_string("( {%d , %d}, %d)", "q", "n", "n").alias("raw"))
    return spark.sql("SELECT q, n, path, depth, kind, value FROM {texts}, LATERAL answer_items(raw)", texts=texts)


@query("extract_solution", f"""{ANSWERS and "WITH " + ANSWERS}, v AS (SELECT DISTINCT q, n FROM answers)
SELECT q, n, 'ok' AS status, CAST(CASE WHEN n % 2 = 0 THEN q ELSE n END AS VARCHAR) AS value, CASE WHEN n % 2 = 0 THEN 'prose_anchor' ELSE 'last_boxed' END AS method FROM v""")
def _(spark, d):
    v = answers(spark, d).select("q", "n").distinct()
    solution = F.when(F.col("n") % 2 == 0, F.format_string("So we add. The final answer is: %d. Done", "q")).otherwise(F.format_string("First \\boxed{%d}, then the answer: %d, at last \\boxed{%d}", "q", "q", "n"))
    scan = A.extractor_udf(A.extract_solution, ("status", "value", "method"))
    return v.withColumn("x", scan(solution)).select("q", "n", "x.status", "x.value", "x.method")


@query("extract_terminal", f"WITH {ANSWERS} SELECT DISTINCT q, n, 'ok' AS status, CAST(q AS VARCHAR) AS value, 'terminal_assignment' AS method FROM answers")
def _(spark, d):
    v = answers(spark, d).select("q", "n").distinct()
    scan = A.extractor_udf(A.extract_terminal, ("status", "value", "method"))
    return v.withColumn("x", scan(F.format_string("We start with %d.\nTherefore x = %d", "n", "q"))).select("q", "n", "x.status", "x.value", "x.method")


@query("solution_outcome", f"""WITH {ANSWERS}, v AS (SELECT DISTINCT q, n, reference FROM answers), s AS (SELECT *, CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(q AS VARCHAR) END AS found FROM v)
SELECT q, n, reference, CASE WHEN found IS NULL THEN 'missing_answer' WHEN found = reference THEN 'accepted' ELSE 'mismatch' END AS outcome FROM s""")
def _(spark, d):
    v = answers(spark, d).select("q", "n", "reference").distinct()
    solution = F.when(F.col("n") % 3 == 0, F.lit("No result here")).otherwise(F.format_string("The answer is %d", "q"))
    scan = A.extractor_udf(A.extract_solution, ("status", "value", "method"))
    found = v.withColumn("x", scan(solution))
    verdict = A.native_status(F.col("x.value"), F.col("reference"), "integer")
    return found.select("q", "n", "reference", F.when(F.col("x.status") != "ok", "missing_answer").when(verdict == "correct", "accepted").otherwise("mismatch").alias("outcome"))


@query("normalize_surface", f"WITH {ANSWERS}, v AS (SELECT DISTINCT raw FROM answers) SELECT raw, CASE WHEN raw LIKE '$%$' THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS surface FROM v")
def _(spark, d):
    return _distinct(spark, d).select("raw").distinct().select("raw", text.normalize_surface(text.canonical_text(F.col("raw"))).alias("surface"))


_FLAT = "CASE WHEN regexp_full_match(txt, '[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?') THEN replace(txt, ',', '') ELSE txt END"


@query("strip_thousands", f"WITH {NUMBERS} SELECT q, n, form, CASE WHEN form = 3 THEN replace(txt, ',', '') END AS flat FROM numbers")
def _(spark, d):
    return numbers(spark, d).select("q", "n", "form", A.strip_thousands(F.col("txt")).alias("flat"))


@query("parse_integer", f"""WITH {NUMBERS} SELECT q, n, form, CASE WHEN regexp_full_match({_FLAT}, '[+-]?\\d+') THEN 'ok' WHEN regexp_full_match({_FLAT}, '[+-]?\\d+\\.\\d*') OR regexp_full_match({_FLAT}, '[+-]?\\d+/[+-]?\\d+') THEN 'not_integer' ELSE 'bad_syntax' END AS status FROM numbers""")
def _(spark, d):
    return numbers(spark, d).select("q", "n", "form", A.integer_status(F.col("txt")).alias("status"))


@query("parse_number", f"""WITH {NUMBERS}, f AS (SELECT q, n, form, {_FLAT} AS t FROM numbers), s AS (
 SELECT q, n, form, CASE WHEN t LIKE '%x' THEN 'bad_syntax' WHEN t LIKE '%/0' THEN 'division_by_zero' END AS error,
  CASE WHEN t LIKE '%/%' THEN TRY_CAST(split_part(t, '/', 1) AS BIGINT) ELSE TRY_CAST(replace(t, '.', '') AS BIGINT) END AS num,
  CASE WHEN t LIKE '%/%' THEN TRY_CAST(split_part(t, '/', 2) AS BIGINT) WHEN contains(t, '.') THEN CAST(pow(10, length(split_part(t, '.', 2))) AS BIGINT) ELSE 1 END AS den FROM f)
SELECT q, n, form, error, CASE WHEN error IS NULL THEN CASE WHEN den // gcd(num, den) = 1 THEN CAST(num // gcd(num, den) AS VARCHAR) ELSE (num // gcd(num, den)) || '/' || (den // gcd(num, den)) END END AS value FROM s""")
def _(spark, d):
    x = numbers(spark, d).withColumn("x", A.fraction(F.col("txt")))
    return x.select("q", "n", "form", "x.error", F.when(F.col("x.error").isNull(), A.canonical_fraction(F.col("x"))).alias("value"))


def _pairs(spark, d):
    return answers(spark, d).select("q", "n").distinct()




@query("parse_flat_set", f"{_PAIRS} SELECT q, n, CAST([CAST(q AS VARCHAR), CAST(n AS VARCHAR), CAST(q AS VARCHAR)] AS VARCHAR[]) AS items FROM v")
def _(spark, d):
    return _pairs(spark, d).select("q", "n", A.flat_items(F.format_string("{%d, %d,%d}", "q", "n", "q"), "{", "}").alias("items"))


@query("canonical_set", f"{_PAIRS} SELECT q, n, CASE WHEN q = n THEN '{{' || q || '}}' ELSE '{{' || least(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) || ', ' || greatest(CAST(q AS VARCHAR), CAST(n AS VARCHAR)) || '}}' END AS form FROM v")
def _(spark, d):
    return _pairs(spark, d).select("q", "n", A.canonical_set(A.flat_items(F.format_string("{%d, %d,%d}", "q", "n", "q"), "{", "}")).alias("form"))


@query("parse_interval", f"{_PAIRS} SELECT q, n, CASE WHEN n % 2 = 0 THEN '(' || n || ', ' || q || ']' ELSE '[' || n || ', ' || q || ')' END AS form FROM v")
def _(spark, d):
    t = F.when(F.col("n") % 2 == 0, F.format_string("( %d,%d ]", "n", "q")).otherwise(F.format_string("[%d, %d)", "n", "q"))
    return _pairs(spark, d).select("q", "n", A.interval_form(A.interval(t)).alias("form"))


def _verdicts(spark, d, kind, left, right):
    rows = answers(spark, d).select("q", "n", "reference").distinct()
    rows = rows.withColumn("p", left).withColumn("r", right)
    return A.verify(rows, "p", "r", kind).select("q", "n", "reference", "verdict")


_VR = f"WITH {ANSWERS}, v AS (SELECT DISTINCT q, n, reference, CAST(reference AS INTEGER) AS r FROM answers)"
_OK = "CASE WHEN {} THEN 'correct' ELSE 'incorrect' END AS verdict FROM v"


@query("verify_integer", f"{_VR} SELECT q, n, reference, CASE WHEN n = 1 THEN 'invalid_prediction' WHEN n = 2 THEN 'incorrect' WHEN q = r THEN 'correct' ELSE 'incorrect' END AS verdict FROM v")
def _(spark, d):
    p = F.when(F.col("n") == 1, F.concat(F.col("q").cast("string"), F.lit("x"))).when(F.col("n") == 2, F.concat(F.col("q").cast("string"), F.lit(".0"))).otherwise(F.col("q").cast("string"))
    return _verdicts(spark, d, "integer", p, F.col("reference"))


@query("verify_rational", f"{_VR} SELECT q, n, reference, {_OK.format('q = r')}")
def _(spark, d):
    return _verdicts(spark, d, "rational", F.format_string("%d/%d", F.col("q") * F.col("n"), "n"), F.concat("reference", F.lit(".0")))


@query("verify_real", f"{_VR} SELECT q, n, reference, {_OK.format('q = r')}")
def _(spark, d):
    return _verdicts(spark, d, "real", F.concat(F.col("q").cast("string"), F.lit(".0000000001")), F.col("reference"))


@query("verify_set", f"{_VR} SELECT q, n, reference, {_OK.format('list_sort(list_distinct([q, n])) = list_sort(list_distinct([r, n]))')}")
def _(spark, d):
    return _verdicts(spark, d, "set", F.format_string("{%d, %d, %d}", "q", "n", "q"), F.format_string("{%d, %s}", "n", "reference"))


@query("verify_tuple", f"{_VR} SELECT q, n, reference, {_OK.format('q = r')}")
def _(spark, d):
    return _verdicts(spark, d, "tuple", F.format_string("(%d, %d)", "q", "n"), F.format_string("(%s, %d)", "reference", "n"))


@query("verify_interval", f"{_VR} SELECT q, n, reference, {_OK.format('q = r AND n <> 3')}")
def _(spark, d):
    p = F.when(F.col("n") == 3, F.format_string("[0, %d]", "q")).otherwise(F.format_string("[0, %d)", "q"))
    return _verdicts(spark, d, "interval", p, F.format_string("[0, %s)", "reference"))


@query("verify_dispatch", f"{_VR} SELECT q, n, reference, {_OK.format('q = r OR q = n')}")
def _(spark, d):
    rows = answers(spark, d).select("q", "n", "reference").distinct()
    results = F.transform(F.array(F.col("reference"), F.col("n").cast("string")), lambda r: A.native_status(F.col("q").cast("string"), r, "integer"))
    verdict = F.aggregate(results, F.lit(None).cast("string"), lambda best, r: F.when(best.isin("correct", "invalid_reference"), best).when(r.isin("correct", "invalid_reference"), r).otherwise(F.coalesce(best, r)))
    return rows.select("q", "n", "reference", verdict.alias("verdict"))


_FORMS = (
    # (prediction, reference): equal if <q> is the reference's number <r>, except where noted; numbers are put in for letters in < >
    (r"<q>x + <n>", r"<n> + x*<r>"),
    (r"\sin(x)^2 + \cos(x)^2 + <q>", r"<r> + 1"),
    (r"\sqrt{<n>*<q>*<q>}", r"<r>\sqrt{<n>}"),
    (r"\ln(3^{<q>})", r"<r>\ln 3"),
    (r"(x+<q>)(x-<n>)", r"x^2 + (<r>-<n>)x - <n>*<r>"),
    (r"\frac{x^2-<q>^2}{x-<q>}", r"x+<r>"),  # never: x = <q> is left out
    (r"x/x + <q>", r"<r> + 1"),  # never
    (r"y + <q>", r"x + <r>"),  # never
    (r"\frac{<q>}{", r"<r>"),  # no expression
    (r"\int x + <q>", r"<r>"),  # beyond the grammar
)


@query("verify_expression", f"""{_VR}, f AS (SELECT DISTINCT q, n, reference, r, unnest(range(10)) AS form FROM v)
SELECT q, n, form, reference, CASE WHEN form = 9 THEN 'undecided' WHEN form = 8 THEN 'invalid_prediction' WHEN form < 5 AND q = r THEN 'correct' ELSE 'incorrect' END AS verdict FROM f""")
def _(spark, d):
    """Equal and unequal pairs of each form: polynomials, identities, roots, logarithms, points left out, other symbols, broken and unread texts."""
    rows = answers(spark, d).select("q", "n", "reference").distinct().withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(len(_FORMS) - 1))))

    def fill(form):
        out = F.lit(form)
        for letter, value in (("q", F.col("q").cast("string")), ("n", F.col("n").cast("string")), ("r", F.col("reference"))):
            out = F.replace(out, F.lit(f"<{letter}>"), value)
        return out

    p, r = (F.element_at(F.array(*[fill(form[k]) for form in _FORMS]), F.col("form") + 1) for k in (0, 1))
    return A.verify(rows.withColumn("p", p).withColumn("r", r), "p", "r", "expression").select("q", "n", F.col("form").cast("long").alias("form"), "reference", "verdict")


_TURN = """turns AS (SELECT DISTINCT form, q, n, CASE form WHEN 0 THEN '<think>a</think> <final>{"answer": "' || q || '"}</final>' WHEN 1 THEN '' WHEN 2 THEN '<final>{"answer": "1"}</final><final>{"answer": "2"}</final>' WHEN 3 THEN '<tool_call>{"name": "python", "arguments": {"x": ' || q || '}}</tool_call>' WHEN 4 THEN 'text <final>{"answer": "1"}</final>' WHEN 5 THEN '<final>{"answer": ' || q || '</final>' WHEN 6 THEN '<final>{"answer": ' || q || '}</final>' ELSE '<tool_call>{"name": "Py", "arguments": {}}</tool_call>' END AS raw FROM answers)"""


@query("parse_action", f"WITH {ANSWERS}, {_TURN} SELECT form, q, n, CASE form WHEN 0 THEN 'final' WHEN 3 THEN 'tool_call' END AS kind, CASE form WHEN 1 THEN 'empty' WHEN 2 THEN 'multiple_actions' WHEN 4 THEN 'invalid_envelope' WHEN 5 THEN 'invalid_json' WHEN 6 THEN 'invalid_schema' WHEN 7 THEN 'invalid_schema' END AS error, sha256(raw) AS raw_hash FROM turns")
def _(spark, d):
    from ..functions.actions import parse_action

    q = F.col("q").cast("string")
    forms = [F.concat(F.lit('<think>a</think> <final>{"answer": "'), q, F.lit('"}</final>')), F.lit(""), F.lit('<final>{"answer": "1"}</final><final>{"answer": "2"}</final>'), F.concat(F.lit('<tool_call>{"name": "python", "arguments": {"x": '), q, F.lit("}}</tool_call>")), F.lit('text <final>{"answer": "1"}</final>'), F.concat(F.lit('<final>{"answer": '), q, F.lit("</final>")), F.concat(F.lit('<final>{"answer": '), q, F.lit("}</final>")), F.lit('<tool_call>{"name": "Py", "arguments": {}}</tool_call>')]
    turns = answers(spark, d).select("form", "q", "n").distinct().withColumn("raw", F.element_at(F.array(*forms), F.col("form") + 1))
    return turns.withColumn("a", parse_action(F.col("raw"))).select("form", "q", "n", "a.kind", "a.error", "a.raw_hash")


@query("sympy_reject", f"{_PAIRS} SELECT q, n, n % 2 = 0 OR q > 40 AS rejected FROM v")
def _(spark, d):
    from ..functions.actions import unsafe_expression

    t = F.when(F.col("n") % 2 == 0, F.lit("__import__('os')")).when(F.col("q") > 40, F.concat(F.lit("x."), F.col("q").cast("string"), F.lit("y"))).otherwise(F.format_string("x**%d + 1", "n"))
    return _pairs(spark, d).select("q", "n", unsafe_expression(t).alias("rejected"))


@query("utf8_truncate", "SELECT doc_id, left(text, 16) AS cut FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def _(spark, d):
    return table(spark, d, "documents").where(~F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", text.utf8_truncate(F.col("text"), 16).alias("cut"))


@query("format_output", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stdout:' || chr(10) || lang WHEN doc_id % 3 = 1 THEN 'stdout:' || chr(10) || lang || chr(10) || 'stderr:' || chr(10) || source ELSE '' END AS output FROM documents")
def _(spark, d):
    from ..functions.actions import format_output

    out, err = F.when(F.col("doc_id") % 3 < 2, F.col("lang")), F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return table(spark, d, "documents").select("doc_id", format_output(out, err).alias("output"))


@query("format_answer", "SELECT doc_id, regexp_replace(text, '[#*`_\\[\\]]', '', 'g') AS plain, length(to_json(struct_pack(answer := lang)))::BIGINT AS json_chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[#*`_\[\]]", "").alias("plain"), F.length(F.to_json(F.struct(F.col("lang").alias("answer")))).cast("long").alias("json_chars"))


@query("python_fence", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'print(' || conv_id || ')' END AS code FROM conversations""")
def _(spark, d):
    from ..functions.actions import python_fence

    c = table(spark, d, "conversations")
    block = F.concat(F.lit("```python\nprint("), F.col("conv_id").cast("string"), F.lit(")\n```\n"))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Run: \n"), block)).when(F.col("turn") % 3 == 1, F.concat(block, F.lit(" or "), block)).otherwise(F.lit("no code"))
    return c.select("conv_id", "turn", python_fence(raw).alias("code"))
