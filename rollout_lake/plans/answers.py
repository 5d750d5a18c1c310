"""Queries over answer extraction, normalisation, grading and code tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as X
from ..functions.text import strip
from ..operators import evaluation as J
from ..operators import scoring as S
from .registry import Tables, query, r6

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
BOXED = X.BOXED_NESTED
FLOAT = X.FLOAT_TEXT


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, replacement: str = "", s: str = "s", flags: str = "g") -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(replacement)}, '{flags}')"


def rp(*pairs: tuple[str, str], s: str = "s") -> str:
    for old, new in pairs:
        s = f"replace({s}, {q(old)}, {q(new)})"
    return s


def cut(*parts: str, s: str = "s") -> str:
    return rp(*[(p, "") for p in parts], s=s)


def chain(src: str, *exprs: str) -> str:
    """Nested selects that rewrite the column s step by step."""
    for e in exprs:
        src = f"SELECT * REPLACE ({e} AS s) FROM ({src})"
    return src


_SLASH = r"""CASE WHEN len(string_split(s, '/')) = 2 AND (regexp_full_match(string_split(s, '/')[1], '0|-?[1-9][0-9]*') OR contains(string_split(s, '/')[1], 'sqrt'))
AND (regexp_full_match(string_split(s, '/')[2], '0|-?[1-9][0-9]*') OR contains(string_split(s, '/')[2], 'sqrt'))
THEN '\frac{' || string_split(s, '/')[1] || '}{' || string_split(s, '/')[2] || '}' ELSE s END"""
_EQ_SIDE = "CASE WHEN len(string_split(s, '=')) = 2 AND length(string_split(s, '=')[1]) <= 2 THEN string_split(s, '=')[2] ELSE s END"
_FRACS = f"""CASE WHEN list_bool_or(list_concat([false], list_transform(string_split(s, '\\frac')[2:], lambda p: NOT starts_with(p, '{{') AND length(p) < 2))) THEN s
ELSE {rx(r'\\frac([^{])[{]', r'\\frac{\1}{', s=rx(r'\\frac([^{])([^{])', r'\\frac{\1}{\2}'))} END"""
_UNITS = "[" + ", ".join(q(u) for u in (*X.UNITS, *[u + "s" for u in X.UNITS])) + "]"
_UNIT_PASS = (
    f"CASE WHEN regexp_matches(s, {q(X.ANY_UNIT)}) THEN list_reduce({_UNITS}, lambda acc, u: CASE WHEN contains(acc, u) OR contains(u, '.') THEN "
    f"coalesce(nullif(regexp_replace(acc, '(^|\\W)' || u || '($|\\W)', '\\1\\2', 'g'), ''), acc) ELSE acc END, s) ELSE s END"
)
_WORDS = """CASE lower(s) WHEN 'twelve' THEN '12' WHEN 'three hundred' THEN '300' WHEN 'twenty one' THEN '21' WHEN 'two thousand five' THEN '2005' WHEN 'zero' THEN '0'
ELSE CASE WHEN regexp_matches(s, '(^|\\s)million($|\\s)') THEN '1000000' WHEN regexp_full_match(s, '[0-9]+') THEN regexp_replace(s, '^0+([0-9])', '\\1') ELSE s END END"""


def normalise_sql(src: str, skip_unit: bool = False) -> str:
    units = [] if skip_unit else [_UNIT_PASS, _UNIT_PASS]
    tail = f"trim({rx(r'\\text\{.*?\}$')}, {WS})"
    first = chain(
        src,
        f"replace(rtrim(replace(trim(s, {WS}), chr(10), ''), '.'), '\\!', '')",
        rx(r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"), rx(r"\\end\{array\}", r"\\end{pmatrix}"),
        rp(("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")),
        cut("\\left", "\\right"), rp(("\\{", "{"), ("\\}", "}")),
        f"CASE WHEN {tail} <> '' THEN {tail} ELSE s END",
        *units,
        cut("^{\\circ}", "^\\circ", "\\$", "$", "\\(", "\\)"), _WORDS, rx(r"\\text\{(.*?)\}", r"\1"),
        cut("x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"),
        rp(("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}")), cut("\\%", "%"),
        rp((" .", " 0."), ("{.", "{0."), ("infinity", "\\infty")),
        f"CASE WHEN contains(s, '\\infty') THEN s ELSE replace(s, 'inf', '\\infty') END",
        cut("and", "\\mathbf"), rx(r"\\mbox\{.*?\}"),
        "CASE WHEN contains(s, 'j') AND NOT contains(s, 'i') THEN replace(s, 'j', 'i') ELSE s END",
        rx(r"(\d+)\.0*([^\d])", r"\1\2"), rx(r"(\d+)\.0*$", r"\1"),
        "CASE WHEN starts_with(s, '.') THEN '0' || s ELSE s END",
        _EQ_SIDE, rx(r"\\sqrt(\w+)", r"\\sqrt{\1}"), "replace(s, ' ', '')", _FRACS, _SLASH,
    )
    return first


def short_sql(src: str) -> str:
    slash = r"""CASE WHEN len(string_split(s, '/')) <> 2 THEN s
WHEN regexp_full_match(string_split(s, '/')[1], '0|-?[1-9][0-9]*') AND regexp_full_match(string_split(s, '/')[2], '0|-?[1-9][0-9]*')
THEN '\frac{' || string_split(s, '/')[1] || '}{' || string_split(s, '/')[2] || '}'
WHEN regexp_full_match(string_split(s, '/')[1], '[+-]?[0-9]+') AND regexp_full_match(string_split(s, '/')[2], '[+-]?[0-9]+') THEN s ELSE NULL END"""
    return chain(
        src, "replace(replace(s, chr(10), ''), '\\!', '')", rp(("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac")),
        cut("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"), "string_split(s, '\\text{ ')[1]", cut("\\%"),
        rp((" .", " 0."), ("{.", "{0.")), "CASE WHEN starts_with(s, '.') THEN '0' || s ELSE s END", _EQ_SIDE,
        rx(r"\\sqrt([^{])", r"\\sqrt{\1}"), "replace(s, ' ', '')", _FRACS, "CASE WHEN s = '0.5' THEN '\\frac{1}{2}' ELSE s END", slash,
    )


def digits_sql(x: str) -> str:
    t = f"replace({x}, ',', '')"
    bare = f"regexp_replace({t}, '\\\\?%$', '')"
    return (f"CASE WHEN regexp_matches({t}, {q(FLOAT)}) THEN CAST(trim({t}) AS DOUBLE) "
            f"WHEN ends_with({t}, '%') AND regexp_matches({bare}, {q(FLOAT)}) THEN CAST(trim({bare}) AS DOUBLE) / 100 END")


def close_sql(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= 1e-4 * greatest(abs({a}), abs({b})))"


def numeric_sql(a: str, b: str) -> str:
    x, y = f"({digits_sql(a)})", f"({digits_sql(b)})"
    return f"({close_sql(x, y + ' / 100')} OR {close_sql(x, y)} OR {close_sql(x, y + ' * 100')})"


def flat_sql(a: str, b: str) -> str:
    framed = f"((starts_with({a}, '[') AND ends_with({a}, ']') AND NOT starts_with({b}, '(')) OR (starts_with({a}, '(') AND ends_with({a}, ')') AND NOT starts_with({b}, '[')))"
    letter = f"coalesce({b} IN ('A','B','C','D','E') AND regexp_extract_all(upper({a}), '\\b([A-E])\\b', 1)[-1] = {b}, false)"
    bare = [f"lower(translate(CASE WHEN {framed} THEN trim({c}, '[]()') ELSE {c} END, '{{}}()', ''))" for c in (a, b)]
    return (f"(lower(trim({a}, {WS})) = lower(trim({b}, {WS})) OR {letter} OR coalesce({numeric_sql(a, b)}, {a} <> '' AND {bare[0]} = {bare[1]}))")


# ---------------------------------------------------------------- boxed answers

@query("f01_last_boxed_in_tail", f"SELECT case_id, regexp_extract_all(right(response, 1500), {q(BOXED)})[-1] AS boxed FROM @responses")
def _(t: Tables):
    return t.view("responses").select("case_id", X.last_boxed_in_tail(F.col("response")).alias("boxed"))


@query("f02_last_boxed", f"SELECT case_id, regexp_extract_all(response, {q(BOXED)})[-1] AS boxed, regexp_extract_all(response, {q(BOXED)}, 1)[-1] AS content FROM @responses")
def _(t: Tables):
    r = t.view("responses").withColumn("boxed", X.last_boxed(F.col("response")))
    return r.select("case_id", "boxed", X.unwrap_boxed(F.col("boxed")).alias("content"))


@query("f02_boxed_in_documents", "SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    # whole documents around a box with three brace levels
    d = t.table("documents").withColumn("wrapped", F.concat("text", F.lit(" \\boxed{"), F.translate("text", "{}", "()"), F.lit("{a{b{c}}}} tail }"), ))
    c = X.boxed_content(F.col("wrapped"))
    plain = F.left(c, F.length(c) - 9)
    same = F.when(plain == strip(F.translate("text", "{}", "()")), F.col("text")).when(
        F.ltrim(plain) == F.ltrim(F.translate("text", "{}", "()")), F.col("text"))
    return d.withColumn("kept", same).select("doc_id", F.md5("kept").alias("digest"), F.length("kept").cast("bigint").alias("n"))


_FIND_BOX = f"""CASE WHEN starts_with(a, '{{') THEN coalesce(nullif(regexp_extract(a, '^[{{]((?:[^{{}}]|[{{](?:[^{{}}]|[{{][^{{}}]*[}}])*[}}])*)[}}]', 1), ''), CASE WHEN starts_with(a, '{{}}') THEN '' ELSE a[2:] END) ELSE trim(string_split(a, '$')[1], {WS}) END"""


@query("f03_find_box", f"SELECT case_id, {_FIND_BOX} AS found FROM (SELECT case_id, string_split(response, 'boxed')[-1] AS a FROM @responses)")
def _(t: Tables):
    return t.view("responses").select("case_id", X.find_box(F.col("response")).alias("found"))


def _ladder_sql(src: str = "SELECT case_id, response AS r FROM @responses") -> str:
    return f"""SELECT case_id, CASE WHEN contains(r, 'final answer is $') AND contains(r, '$. I hope') THEN trim(string_split(string_split(r, 'final answer is $')[2], '$. I hope')[1], {WS})
WHEN contains(r, 'boxed') THEN {_FIND_BOX} WHEN contains(r, 'he answer is') THEN trim(string_split(r, 'he answer is')[-1], {WS})
WHEN contains(r, 'final answer is') THEN trim(string_split(r, 'final answer is')[-1], {WS})
ELSE coalesce(regexp_extract_all(replace(r, ',', ''), {q(X.NUMBER)})[-1], '') END AS s
FROM (SELECT case_id, r, string_split(r, 'boxed')[-1] AS a FROM ({src}))"""


_LADDER_TAIL = [rx(r"\n\s*"), rx(r"^:", flags=""), rx(r"\.$", flags=""), rx(r"/$", flags="")]


@query("f04_extract_answer", f"SELECT case_id, s AS answer FROM ({normalise_sql(chain(_ladder_sql(), *_LADDER_TAIL))})")
def _(t: Tables):
    return t.view("responses").select("case_id", X.extract_answer(F.col("response"), "math").alias("answer"))


@query("f05_normalise", f"SELECT case_id, s AS normal FROM ({normalise_sql('SELECT case_id, pred AS s FROM @answers')})")
def _(t: Tables):
    return t.view("answers").select("case_id", X.normalise(F.col("pred")).alias("normal"))


@query("f05_normalise_keep_units", f"SELECT case_id, s AS normal FROM ({normalise_sql('SELECT case_id, gold AS s FROM @answers', skip_unit=True)})")
def _(t: Tables):
    return t.view("answers").select("case_id", X.normalise(F.col("gold"), skip_unit=True).alias("normal"))


@query("f06_normalise_short", f"SELECT case_id, s AS normal FROM ({short_sql('SELECT case_id, pred AS s FROM @answers')})")
def _(t: Tables):
    return t.view("answers").select("case_id", X.normalise_short(F.col("pred")).alias("normal"))


@query("f07_same_after_short", f"""SELECT a.case_id, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN a.s = b.s ELSE a.pred = a.gold END AS same
FROM ({short_sql('SELECT case_id, pred, gold, pred AS s FROM @answers')}) a JOIN ({short_sql('SELECT case_id, gold AS s FROM @answers')}) b ON a.case_id = b.case_id""")
def _(t: Tables):
    return t.view("answers").select("case_id", X.same_after_short(F.col("pred"), F.col("gold")).alias("same"))


@query("f08_choice_answer", f"""SELECT case_id, rtrim(rtrim(coalesce(CASE WHEN n > 1 THEN l[1] ELSE l[-1] END, trim(trim(b, {WS}), '.')), '.'), '/') AS choice FROM (
SELECT *, regexp_extract_all(upper(b), '\\b([A-E])\\b', 1) AS l FROM (
SELECT *, ltrim(trim(rtrim(rtrim(trim(p[-1], chr(10)), '.'), '/'), ' '), ':') AS b, len(p) AS n FROM (
SELECT case_id, regexp_split_to_array(trim(response, chr(10)), 'choice is|answer is') AS p FROM @responses)))""")
def _(t: Tables):
    return t.view("responses").select("case_id", X.choice_answer(F.col("response")).alias("choice"))


@query("f08_multi_choice", """SELECT case_id, CASE WHEN l <> '' THEN upper(l) ELSE 'placeholder' END AS choice FROM (
SELECT case_id, regexp_extract(lower(replace(string_split(response, 'Problem:')[1], 'choice is', 'answer is')), 'answer is \\(?([abcde])\\)?', 1) AS l FROM @responses)""")
def _(t: Tables):
    return t.view("responses").select("case_id", X.multi_choice(F.col("response")).alias("choice"))


_CLEAN_UNITS = [rp(("\\pi", "π")), rx(r"(^|[^\d}])\\?π", r"\g3.14").replace("\\g", "\\1"), rx(r"(\d)(\\?π)", r"\1*3.14"), rx(r"\{(\\?π)\}", "3.14"), rx(r"\*(\\?π)", "*3.14"),
                rp(("%", "/100")), cut("$", "¥", "°C", " C", "°")]


@query("f09_theorem_answer", f"""WITH b AS (SELECT case_id, pred, lower(pred) AS low, CASE WHEN contains(pred, 'boxed') THEN 'x' ELSE trim(string_split(pred, '=')[-1], {WS}) END AS s FROM @answers),
c AS ({chain('SELECT * FROM b', *_CLEAN_UNITS)})
SELECT case_id, CASE WHEN regexp_matches(low, 'yes|true') THEN 'True' WHEN regexp_matches(low, 'no|false') THEN 'False' WHEN regexp_matches(low, '\\([a-f]\\)') THEN pred
WHEN regexp_matches(s, '^-?[\\d\\.]+\\s\\D+$') OR regexp_matches(s, '^-?[\\d\\.]+\\s[^\\s]+$') THEN string_split(s, ' ')[1] ELSE s END AS answer FROM c""")
def _(t: Tables):
    return t.view("answers").select("case_id", X.theorem_answer(F.col("pred")).alias("answer"))


@query("f10_parse_digits", f"SELECT case_id, {r6(digits_sql('pred'))} AS number FROM @answers")
def _(t: Tables):
    return t.view("answers").select("case_id", F.round(X.parse_digits(F.col("pred")), 6).alias("number"))


@query("f11_numeric_match", f"SELECT case_id, {numeric_sql('pred', 'gold')} AS hit FROM @answers")
def _(t: Tables):
    return t.view("answers").select("case_id", X.numeric_match(F.col("pred"), F.col("gold")).alias("hit"))


def _all_flat(pa: str, pb: str) -> str:
    return f"(len({pa}) = len({pb}) AND list_bool_and(list_transform(range(1, len({pa}) + 1), lambda i: coalesce({flat_sql(f'{pa}[i]', f'{pb}[i]')}, false))))"


def math_equal_sql(src: str) -> str:
    return f"""SELECT case_id, CASE WHEN flat THEN true WHEN num IS NOT NULL THEN false ELSE coalesce(p <> '' AND (tuple_hit OR matrix_hit OR coalesce(CASE WHEN NOT contains(r, '=') THEN ({flat_sql('pe', 'r')})
WHEN NOT contains(p, '=') THEN ({flat_sql('p', 're')}) END, false)), false) END AS equal FROM (
SELECT *, {flat_sql('pred', 'gold')} AS flat, {numeric_sql('pred', 'gold')} AS num,
CASE WHEN len(string_split(p, '=')) = 2 AND length(trim(string_split(p, '=')[1])) <= 2 THEN string_split(p, '=')[2] END AS pe,
CASE WHEN len(string_split(r, '=')) = 2 AND length(trim(string_split(r, '=')[1])) <= 2 THEN string_split(r, '=')[2] END AS re,
regexp_matches(p, '^[(\\[].+[)\\]]') AND regexp_matches(r, '^[(\\[].+[)\\]]') AND {_all_flat("string_split(p[2:-2], ',')", "string_split(r[2:-2], ',')")} AS tuple_hit,
starts_with(p, '\\begin{{pmatrix}}') AND starts_with(r, '\\begin{{pmatrix}}') AND {_all_flat("pc", "rc")} AS matrix_hit
FROM (SELECT case_id, pred, gold, trim(pred) AS p, trim(gold) AS r, regexp_split_to_array(replace(replace(pred, '\\begin{{pmatrix}}', ''), '\\end{{pmatrix}}', ''), '&|\\\\\\\\') AS pc,
regexp_split_to_array(replace(replace(gold, '\\begin{{pmatrix}}', ''), '\\end{{pmatrix}}', ''), '&|\\\\\\\\') AS rc FROM ({src})))"""


@query("f12_math_equal", math_equal_sql("SELECT case_id, pred, gold FROM @answers"))
def _(t: Tables):
    return t.view("answers").select("case_id", X.math_equal(F.col("pred"), F.col("gold")).alias("equal"))


_COMMA = rx(r"(\d),(\d\d\d)($|\D)", r"\1\2\3")


def strict_sql(src: str) -> str:
    whole = f"CASE WHEN regexp_matches(s, {q(FLOAT)}) AND abs(TRY_CAST(trim(s) AS DOUBLE) - round(TRY_CAST(trim(s) AS DOUBLE))) <= 1e-7 THEN CAST(CAST(round(TRY_CAST(trim(s) AS DOUBLE)) AS BIGINT) AS STRING) ELSE s END"
    nc = f"({_COMMA})"
    whole_c = whole.replace("(s,", f"({nc},").replace("trim(s)", f"trim({nc})")
    inner = f"regexp_extract(s, '^\\\\text\\{{(.+?)\\}}$', 1)"
    units = "s"
    for u in X.STRICT_UNITS:
        units = rx(rf"{u}(es)?(s)? *(\^[0-9]+)?", s=units)
    frac = rx(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", s=rp(("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac")))
    sqrt = rx(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", s=frac)
    tex = f"trim({rp((chr(92) + 'pi', 'pi'), (chr(92) + 'infty', 'inf'), (chr(92) + 'cup', 'U'), (chr(92) + 'cdot', '*'), (chr(92) + 'times', '*'), s=sqrt)}, {WS})"
    return chain(
        src, f"CASE WHEN {inner} <> '' THEN {inner} ELSE s END", rp(("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", "")),
        rp((" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")), units, rx(r"\^ *\\circ"),
        "CASE WHEN starts_with(s, '{') AND ends_with(s, '}') AND length(s) > 1 THEN s[2:-2] ELSE s END", rx(r",\\! *"), whole,
        f"CASE WHEN contains(s, '\\') THEN {tex} ELSE s END", rx("- *", "-"), rx("([0-9]) +([0-9])", r"\1+\2"), "lower(s)", whole_c,
    )


@query("f13_normalise_strict", f"SELECT case_id, s AS normal FROM ({strict_sql('SELECT case_id, pred AS s FROM @answers')})")
def _(t: Tables):
    return t.view("answers").select("case_id", X.normalise_strict(F.col("pred")).alias("normal"))


@query("f14_split_tuple", f"""SELECT case_id, array_to_string(CASE WHEN s = '' THEN [] WHEN regexp_matches(s, '^[()\\[\\]].+[()\\[\\]]$') AND NOT regexp_matches(s[2:-2], '[()\\[\\]]')
THEN list_transform(string_split(s[2:-2], ','), lambda x: trim(x, {WS})) ELSE [s] END, '|') AS parts FROM ({chain('SELECT case_id, pred AS s FROM @answers', _COMMA, _COMMA)})""")
def _(t: Tables):
    return t.view("answers").select("case_id", F.array_join(X.split_tuple(F.col("pred")), "|").alias("parts"))


def grade_sql(src: str) -> str:
    """Strict grade over a select of case_id, g (may be null) and t."""
    def light(c):
        inner = f"regexp_extract(trim({c}, {WS}), '^\\\\text\\{{(.+?)\\}}$', 1)"
        text = f"CASE WHEN {inner} <> '' THEN trim({inner}, {WS}) ELSE trim({c}, {WS}) END"
        return f"SELECT case_id, coalesce(s, o) AS v FROM ({short_sql(f'SELECT case_id, {text} AS s, {text} AS o FROM ({src})')})"

    def strict(c):
        return strict_sql(f"SELECT case_id, {c} AS s FROM ({src})")

    def parts(c):
        return (f"CASE WHEN {c} = '' THEN [] WHEN regexp_matches({c}, '^[()\\[\\]].+[()\\[\\]]$') AND NOT regexp_matches({c}[2:-2], '[()\\[\\]]') "
                f"THEN list_transform(string_split({c}[2:-2], ','), lambda x: trim(x, {WS})) ELSE [{c}] END")

    def nocomma(c):
        return rx(r"(\d),(\d\d\d)($|\D)", r"\1\2\3", s=c)

    frac = q(X._FRACTION)
    number = "TRY_CAST(trim({}) AS DOUBLE)"
    whole = "coalesce(regexp_matches({0}, " + q(FLOAT) + ") AND abs(TRY_CAST(trim({0}) AS DOUBLE) - round(TRY_CAST(trim({0}) AS DOUBLE))) <= 1e-7, false)"
    x, y = "ge[i]", "te[i]"
    alike = f"({x} = {y} OR (regexp_matches({x}, {q(FLOAT)}) AND regexp_matches({y}, {q(FLOAT)}) AND {number.format(x)} = {number.format(y)}))"
    element = f"CASE WHEN regexp_matches({x}, {frac}) AND regexp_matches({y}, {frac}) THEN {x} = {y} WHEN {whole.format(x)} <> {whole.format(y)} THEN false ELSE {alike} END"
    return f"""SELECT case_id, CASE WHEN g IS NULL THEN false WHEN lg = lt THEN true WHEN sg = st THEN true WHEN sg = '' THEN false
WHEN len(te) > 1 AND (left(sg, 1) <> left(st, 1) OR right(sg, 1) <> right(st, 1)) THEN false WHEN len(ge) <> len(te) THEN false
ELSE coalesce(list_bool_and(list_transform(range(1, len(te) + 1), lambda i: {element})), true) END AS correct FROM (
SELECT b.case_id, b.g, lg.v AS lg, lt.v AS lt, sg.s AS sg, st.s AS st, {parts(nocomma('sg.s'))} AS ge, {parts(nocomma('st.s'))} AS te
FROM ({src}) b JOIN ({light('g')}) lg ON b.case_id = lg.case_id JOIN ({light('t')}) lt ON b.case_id = lt.case_id
JOIN ({strict('g')}) sg ON b.case_id = sg.case_id JOIN ({strict('t')}) st ON b.case_id = st.case_id)"""


@query("f15_grade_strict", grade_sql("SELECT case_id, pred AS g, gold AS t FROM @answers"))
def _(t: Tables):
    return t.view("answers").select("case_id", X.grade_strict(F.col("pred"), F.col("gold")).alias("correct"))


def _match_sql() -> str:
    src = "SELECT case_id, response AS s, false AS m FROM @responses"

    def step(hit, expr):
        nonlocal src
        src = f"SELECT * REPLACE (CASE WHEN {hit} THEN trim({expr}, {WS}) ELSE s END AS s, (m OR {hit}) AS m) FROM ({src})"

    def tail(mark):
        return f"length(string_split(lower(s), {mark})[-1])"

    def after(mark):
        step(f"contains(lower(s), {q(mark)})", f"right(s, {tail(q(mark))})")

    for mark in X.AFTER_MARKERS:
        after(mark)
    for mark in X.BEFORE_MARKERS:
        step(f"contains(lower(s), {q(mark)})", f"left(s, length(s) - {tail(q(mark))} - {len(mark)})")
    box = f"trim(regexp_extract_all(s, {q(BOXED)}, 1)[-1], {WS})"
    step(f"coalesce({box}, '') <> ''", box)
    src = f"SELECT * REPLACE (CASE WHEN contains(s, '. ') THEN trim(left(s, length(s) - length(string_split(s, '. ')[-1]) - 2), {WS}) ELSE s END AS s) FROM ({src})"
    for mark in X.VERB_MARKERS:
        after(mark)
    return f"SELECT case_id, m AND regexp_matches(s, '\\d') AS matched, s AS answer FROM ({src})"


@query("f16_match_answer", _match_sql())
def _(t: Tables):
    m = t.view("responses").withColumn("m", X.match_answer(F.col("response")))
    return m.select("case_id", "m.matched", "m.answer")


@query("f17_hash_answer", """SELECT case_id, CASE WHEN a IS NULL OR a = '' THEN NULL ELSE replace(replace(a, ',', ''), '$', '') END AS strict_answer, f AS flexible_answer,
CASE WHEN a IS NULL OR a = '' THEN 0e0 WHEN replace(a, ',', '') = concat(problem_id, '000') THEN 1e0 ELSE 0.1e0 END AS score FROM (
SELECT case_id, problem_id, regexp_extract(response, '#### (-?[0-9.,]+)', 1) AS a, coalesce(list_filter(l, lambda x: x NOT IN ('', '.'))[-1], l[1]) AS f
FROM (SELECT *, regexp_extract_all(response, '(-?[0-9.,]+)', 1) AS l FROM @responses))""")
def _(t: Tables):
    r = F.col("response")
    truth = F.concat(F.col("problem_id").cast("string"), F.lit("000"))
    return t.view("responses").select(
        "case_id", X.hash_answer(r).alias("strict_answer"), X.hash_answer(r, "flexible").alias("flexible_answer"),
        X.hash_score(r, truth, format_score=0.1).alias("score"))


@query("f18_think_score", f"""SELECT g.case_id, {r6("9e-1 * CASE WHEN correct THEN 1 ELSE 0 END + 1e-1 * CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed[{].*[}].*') THEN 1 ELSE 0 END")} AS score
FROM ({grade_sql(f"SELECT case_id, trim(regexp_extract_all(response, {q(BOXED)}, 1)[-1], {WS}) AS g, gold AS t FROM @responses")}) g JOIN @responses r ON g.case_id = r.case_id""")
def _(t: Tables):
    return t.view("responses").select("case_id", F.round(X.think_score(F.col("response"), F.col("gold")), 6).alias("score"))


@query("f19_trim_transcript", f"""SELECT case_id, md5(CASE WHEN contains(s, '<|im_end|>') THEN trim(string_split(s, '<|im_end|>')[1], {WS}) ELSE s END) AS digest FROM (
SELECT case_id, regexp_replace(concat('<|im_start|>user', chr(10), gold, '<|im_end|>', chr(10), '<|im_start|>assistant', response), '(?s)^.*?<\\|im_start\\|>assistant', '<|im_start|>assistant') AS s FROM @responses)""")
def _(t: Tables):
    whole = F.concat(F.lit("<|im_start|>user\n"), "gold", F.lit("<|im_end|>\n<|im_start|>assistant"), "response")
    return t.view("responses").select("case_id", F.md5(X.trim_transcript(whole)).alias("digest"))


_TRIMMED = f"SELECT case_id, gold, response, CASE WHEN contains(response, '<|im_end|>') THEN trim(string_split(response, '<|im_end|>')[1], {WS}) ELSE response END AS r FROM @responses"
_ANSWERED = f"SELECT a.case_id, a.s AS pred, r.gold FROM ({normalise_sql(chain(_ladder_sql(f'SELECT case_id, r FROM ({_TRIMMED})'), *_LADDER_TAIL))}) a JOIN @responses r ON a.case_id = r.case_id"
TRANSCRIPT_SQL = f"""SELECT e.case_id, CASE WHEN equal THEN 1e0 ELSE 0e0 END AS score, CASE WHEN len(regexp_extract_all(right(r, 1500), {q(BOXED)})) > 0 THEN 1 ELSE 0 END AS is_boxed_ratio,
CASE WHEN regexp_matches(response, '(?s)```(?:py|python)?\\n.*?\\n```\\nCode execution result:') THEN 1 ELSE 0 END AS valid_code FROM ({math_equal_sql(_ANSWERED)}) e JOIN ({_TRIMMED}) t ON e.case_id = t.case_id"""


@query("f20_transcript_score", TRANSCRIPT_SQL)
def _(t: Tables):
    s = t.view("responses").withColumn("s", S.transcript_score(F.col("response"), F.col("gold")))
    return s.select("case_id", "s.*")


_ROUTE = "CASE WHEN c_custkey % 2 = 0 THEN concat('x/deepscaler_', c_mktsegment) ELSE concat('y/livecode_', c_mktsegment) END"


@query("f21_route_exact", "SELECT sol_id, CASE WHEN sol_id % 2 = 0 THEN balance ELSE -balance END AS score FROM @code_tasks")
def _(t: Tables):
    src = F.when(F.col("sol_id") % 2 == 0, "openai/gsm8k").otherwise("lighteval/MATH")
    scorers = {"openai/gsm8k": F.col("balance"), "lighteval/MATH": -F.col("balance")}
    return t.view("code_tasks").select("sol_id", S.route_exact(src, scorers).alias("score"))


@query("f21_route_by_source", f"SELECT sol_id, CASE WHEN sol_id % 2 = 0 THEN balance ELSE -1e0 END AS score FROM @code_tasks")
def _(t: Tables):
    src = F.when(F.col("sol_id") % 2 == 0, F.concat(F.lit("x/deepscaler_"), "segment")).otherwise(F.concat(F.lit("y/livecode_"), "segment"))
    return t.view("code_tasks").select("sol_id", S.route(src, F.col("balance"), F.lit(-1.0)).alias("score"))


def _runs(t: Tables):
    slots = F.array(*[F.struct(F.col(f"out{i}").alias("stdout"), F.col(f"err{i}").alias("stderr")) for i in range(3)])
    return t.view("code_runs").select("sol_id", F.posexplode(slots).alias("test_idx", "r")).select(
        "sol_id", F.col("test_idx").cast("bigint").alias("test_idx"), "r.stdout", "r.stderr")


_TESTS_SQL = f"""SELECT t.sol_id, t.idx AS test_idx, t.code, t.form, CASE WHEN t.form = 1 THEN NULL WHEN t.form = 0 THEN [CAST(t.sol_id AS STRING), '7'][idx + 1] ELSE [CAST(t.sol_id AS STRING), '5', '6'][idx + 1] END AS expected,
[out0, out1, out2][idx + 1] AS stdout, [err0, err1, err2][idx + 1] AS stderr
FROM (SELECT *, sol_id % 3 AS form, unnest(CASE sol_id % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [0, 1, 2] END) AS idx FROM @code_tasks WHERE code <> '') t JOIN @code_runs r ON t.sol_id = r.sol_id"""
_JUDGED_SQL = f"SELECT *, stderr = '' AND (form = 1 OR trim(stdout, {WS}) = trim(expected, {WS})) AS passed FROM ({_TESTS_SQL})"


def _judged(t: Tables):
    tests = S.expand_tests(t.view("code_tasks"), "sol_id", "code", "truth")
    return S.judge_tests(tests, _runs(t), "sol_id")


@query("f22_code_score", f"""SELECT t.sol_id, CASE WHEN t.code <> '' AND coalesce(ok, true) THEN 1e0 ELSE 0e0 END AS score, CASE WHEN t.code <> '' THEN 1 ELSE 0 END AS valid_code
FROM @code_tasks t LEFT JOIN (SELECT sol_id, bool_and(passed) AS ok FROM ({_JUDGED_SQL}) GROUP BY 1) j ON t.sol_id = j.sol_id""")
def _(t: Tables):
    return S.code_score(t.view("code_tasks"), _judged(t), "sol_id", "code").select("sol_id", "score", "valid_code")


@query("f23_functional_program", f"""SELECT sol_id, CAST(idx AS BIGINT) AS test_idx, md5(CASE WHEN form = 0 AND idx = 1 THEN concat(code, chr(10), 'sol = Solution()', chr(10), 'print(sol.solve([1,2], 3))')
WHEN form = 1 THEN concat(code, chr(10), 'assert f(1) == 2') ELSE code END) AS digest FROM (SELECT *, test_idx AS idx FROM ({_TESTS_SQL}))""")
def _(t: Tables):
    tests = S.expand_tests(t.view("code_tasks"), "sol_id", "code", "truth")
    return tests.select("sol_id", "test_idx", F.md5("program").alias("digest"))


@query("f24_partial_code_score", f"SELECT sol_id, {r6('CASE WHEN bool_and(passed) THEN 1e0 ELSE avg(CASE WHEN test_idx < 10 THEN CAST(passed AS INTEGER) END) END')} AS score FROM ({_JUDGED_SQL}) GROUP BY 1")
def _(t: Tables):
    return S.partial_code_score(_judged(t), "sol_id").withColumn("score", F.round("score", 6))


@query("f25_same_output", f"""SELECT conv_id, turn, trim(text, {WS}) = trim(b, {WS}) OR trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), chr(10)), {WS}) = trim(b, {WS}) AS same
FROM (SELECT *, CASE turn % 3 WHEN 0 THEN concat(text, '  ', chr(10)) WHEN 1 THEN replace(text, chr(10), concat(' ', chr(10))) ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), chr(10)) END AS b FROM conversations)""")
def _(t: Tables):
    lines = F.split("text", "\n")
    trimmed = F.array_join(F.transform(lines, strip), "\n")
    b = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("  \n"))).when(F.col("turn") % 3 == 1, F.replace("text", F.lit("\n"), F.lit(" \n"))).otherwise(trimmed)
    return t.table("conversations").withColumn("b", b).select("conv_id", "turn", S.same_output(lines, F.col("b")).alias("same"))


@query("f26_failure_default", """SELECT sol_id, CASE WHEN sol_id % 4 = 0 OR balance < 0 THEN 0e0 ELSE balance END AS score, CASE WHEN sol_id % 4 = 0 OR balance < 0 THEN 1 ELSE 0 END AS is_filter,
CASE WHEN segment = 'BUILDING' THEN 0e0 ELSE balance END AS extra_a, 0e0 AS extra_b FROM @code_tasks""")
def _(t: Tables):
    bal = F.col("balance")
    score = F.when(bal >= 0, bal)
    info = F.struct(F.when(F.col("segment") != "BUILDING", bal).alias("extra_a"), F.lit(None).cast("double").alias("extra_b"))
    out = t.view("code_tasks").withColumns({"s": S.settle_score(score, F.col("sol_id") % 4 == 0), "x": S.fill_extra(info, ["extra_a", "extra_b"])})
    return out.select("sol_id", "s.*", "x.*")


@query("f28_examples_per_source", "SELECT segment, sol_id, rank FROM (SELECT segment, sol_id, row_number() OVER (PARTITION BY segment ORDER BY sol_id) AS rank FROM @code_tasks) WHERE rank <= 2")
def _(t: Tables):
    f = J.first_per_source(t.view("code_tasks").select("segment", "sol_id"), "segment", ["sol_id"], 2)
    return f.withColumn("rank", F.col("rank").cast("bigint"))


@query("f29_prefer_model_score", "SELECT uid, line, part, supp, price, CASE WHEN tax > 0.04 THEN soft ELSE score END AS score FROM @rollouts")
def _(t: Tables):
    rm = F.when(F.col("tax") > 0.04, F.col("soft"))
    return t.view("rollouts").select("uid", "line", "part", "supp", "price", S.prefer_model_score(rm, F.col("score")).alias("score"))


_LOOSE = "replace(replace({}, ',', ''), '$', '')"


def _rough_sql() -> str:
    w = _LOOSE.format("w")
    num = f"CASE WHEN ends_with({w}, '%') THEN CASE WHEN regexp_matches(rtrim({w}, '%'), {q(FLOAT)}) THEN CAST(rtrim({w}, '%') AS DOUBLE) / 100 END WHEN regexp_matches({w}, {q(FLOAT)}) THEN CAST({w} AS DOUBLE) END"
    gold = f"CASE WHEN regexp_matches({_LOOSE.format('gold')}, {q(FLOAT)}) THEN CAST({_LOOSE.format('gold')} AS DOUBLE) END"
    ops = "('+', '-', '*', '/', '^')"
    ok = (f"NOT coalesce(i > 1 AND ws[i - 1] IN {ops}, false) AND NOT coalesce(ws[i + 1] IN {ops}, false) AND regexp_matches(w, '\\d') "
          f"AND coalesce(abs({num} - a) < 1e-3, false) AND NOT contains(w[i:], '=')")
    return f"""SELECT case_id, CASE WHEN len(list_filter(list_transform(ws, lambda w, i: {ok}), lambda x: x)) > 0 THEN 1 ELSE 0 END AS hit FROM (
SELECT case_id, {gold} AS a, list_filter(regexp_split_to_array(coalesce(list_filter(string_split(response, chr(10)), lambda l: regexp_matches(l, '\\d'))[-1], string_split(response, chr(10))[1]), '\\s+'), lambda w: w <> '') AS ws FROM @responses)"""


@query("f30_rough_match", _rough_sql())
def _(t: Tables):
    return t.view("responses").select("case_id", X.rough_match(F.col("response"), F.col("gold")).alias("hit"))


def expression_sql(src: str) -> str:
    return chain(
        src,
        rp((" . ", "."), (". ", "."), ("**", "^"), ("\\pm", ""), ("*", "\\times "), ("\\\\", "\\"), ("\\ne ", "\\neq "), ("!=", "\\neq"), (">=", "\\ge"), ("<=", "\\le"), ("≠", "\\neq"), ("dfrac", "frac"), ("tfrac", "frac")),
        cut("\\$", "$", "\\%", "%", "\\!"), rp(("^\\circ", "\\times \\pi / 180"), ("//", "/"), ('"', "")), rx(r"\\+", r"\\"), rx(r"\^\s?\((.*?)\)", r"^{\1}"),
        rx(r"\\frac\s?(\d)\s?(\d+)", r"\\frac{\1}{\2}"), rx(r"\\log_\s?(\d)\s?(\d+)", r"\\log_{\1}{\2}"), rx(r"\\frac\s?\{(.*?)\}\s?(\d)", r"\\frac{\1}{\2}"),
        rx(r"\\frac\s?(\d)\s?\{(.*?)\}", r"\\frac{\1}{\2}"), rx(r"\\sqrt\s?(\d)", r"\\sqrt{\1}"), rx(r"sqrt\s?\((\d+)\)", r"\\sqrt{\1}"), rx(r"sqrt\s?\((.*?)\)", r"\\sqrt{\1}"),
        rp((" sqrt", "\\sqrt")), cut("\\left", "\\right.", "\\right"),
    )


@query("f31_clean_expression", f"SELECT case_id, s AS cleaned FROM ({expression_sql('SELECT case_id, pred AS s FROM @answers')})")
def _(t: Tables):
    return t.view("answers").select("case_id", X.clean_expression(F.col("pred")).alias("cleaned"))


@query("f31_percent_and_number", f"""SELECT case_id, CASE WHEN regexp_matches(p, '\\d+%') THEN replace(p, concat(n, '%'), CAST(CAST(n AS DOUBLE) / 100 AS STRING)) ELSE p END AS as_fraction,
coalesce(regexp_extract_all(replace(response, ',', ''), '-?\\d+\\.?\\d*')[-1], '') AS number FROM (
SELECT *, regexp_extract(p, '(\\d+)%', 1) AS n FROM (SELECT case_id, response, replace(pred, '\\%', '%') AS p FROM @responses))""")
def _(t: Tables):
    p = F.replace("pred", F.lit("\\%"), F.lit("%"))
    return t.view("responses").select("case_id", X.percent_to_fraction(p).alias("as_fraction"), X.number_in(F.col("response")).alias("number"))


_TWICE = normalise_sql(f"SELECT case_id, s FROM ({normalise_sql(chain(_ladder_sql(), *_LADDER_TAIL))})")


@query("f32_prediction", f"SELECT a.case_id, CASE WHEN r.kind = '5-LOW' THEN NULL ELSE s END AS prediction FROM ({_TWICE}) a JOIN @responses r ON a.case_id = r.case_id")
def _(t: Tables):
    result = F.when(F.col("kind") == "5-LOW", F.lit("error")).otherwise(F.col("response"))
    return t.view("responses").select("case_id", X.prediction_for(result, "math").alias("prediction"))


@query("f33_normalise_number", f"""SELECT case_id, CASE WHEN regexp_matches(s, '^\\$\\d+(\\.\\d+)?') THEN s[2:] WHEN regexp_matches(s, '^\\d+(\\.\\d+)?\\\\?%$') THEN replace(replace(s, '\\%', ''), '%', '')
WHEN contains(s, '_') THEN CAST(CAST(string_split(s, '_')[1] AS BIGINT) AS STRING) ELSE s END AS normal FROM (
SELECT case_id, CASE WHEN case_id % 24 = 13 THEN concat(CAST(problem_id % 100 AS STRING), '_', CAST(7 AS STRING)) ELSE pred END AS s FROM @answers)""")
def _(t: Tables):
    s = F.when(F.col("case_id") % 24 == 13, F.concat((F.col("problem_id") % 100).cast("string"), F.lit("_7"))).otherwise(F.col("pred"))
    return t.view("answers").select("case_id", X.normalise_number(s).alias("normal"))


@query("f33_interval_text", "SELECT case_id, CASE case_id % 4 WHEN 0 THEN concat('[', b, ']') WHEN 1 THEN concat('[', b, ')') WHEN 2 THEN concat('(', b, ']') ELSE concat('(', b, ')') END AS text FROM (SELECT case_id, concat(CAST(problem_id AS STRING), ', ', gold) AS b FROM @answers)")
def _(t: Tables):
    body = F.concat(F.col("problem_id").cast("string"), F.lit(", "), "gold")
    k = F.col("case_id") % 4
    name = F.when(k == 0, "Interval").when(k == 1, "Interval.Ropen").when(k == 2, "Interval.Lopen").otherwise("Interval.open")
    return t.view("answers").select("case_id", X.interval_text(F.concat(name, F.lit("("), body, F.lit(")"))).alias("text"))


@query("f34_set_to_matrix", "SELECT case_id, CASE WHEN case_id % 3 = 0 THEN '' ELSE concat('\\begin{pmatrix}', replace(b, ',', '\\'), '\\end{pmatrix}') END AS matrix FROM (SELECT case_id, concat(CAST(problem_id AS STRING), ',', CAST(case_id AS STRING), ', 3') AS b FROM @answers)")
def _(t: Tables):
    body = F.concat(F.col("problem_id").cast("string"), F.lit(","), F.col("case_id").cast("string"), F.lit(", 3"))
    text = F.when(F.col("case_id") % 3 == 0, body).otherwise(F.concat(F.lit(" {"), body, F.lit("} ")))
    return t.view("answers").select("case_id", X.set_to_matrix(text).alias("matrix"))


@query("f35_same_expression", f"""SELECT a.case_id, translate(a.s, ',$ ', '') = translate(b.s, ',$ ', '') AS same
FROM ({expression_sql('SELECT case_id, pred AS s FROM @answers')}) a JOIN ({expression_sql('SELECT case_id, gold AS s FROM @answers')}) b ON a.case_id = b.case_id""")
def _(t: Tables):
    return t.view("answers").select("case_id", X.same_expression(F.col("pred"), F.col("gold")).alias("same"))
