"""Column builders that extract, normalise and compare written answers.

Each step of a normaliser binds its input once (``let``), so a long chain stays linear
in its length however often a step mentions its input.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import FENCED, RAN_CODE, SPACES, has, replace, strip  # noqa: F401

# ---- fixed values of the graders, as text
BOXED_NESTED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
BOXED_TAIL = 1500
NUMBER = r"-?\d*\.?\d+"
FLOAT_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
CHOICE_SETS = ("mmlu_stem", "sat_math", "aqua", "gaokao2023")
UNIT_EXCEPTIONS = ("carp_en", "minerva_math")
TRIGGERS = ("choice is", "answer is")
STOP_WORDS = ("</s>", "<|im_end|>", "<|endoftext|>", "[END]")
LAST_TURN = "<|im_start|>assistant"
UNITS = (
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile", "q .", "monkey", "prime",
    "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb", "tile", "per", "dm", "lt", "gain", "ab", "way", "west",
    "a .", "b .", "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change", "men", "soldier", "pie", "bc",
    "excess", "st", "inches", "noon", "percent", "by", "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq",
    "mark", "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women", "feet", "am", "pm", "hr",
    "cu cm", "square", "v â € ™", "are", "rupee", "rounds", "cubic", "cc", "mtr", "s", "ohm", "number", "kmph", "day",
    "hour", "minute", "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³", "hectare",
    "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g", "month", "km", "m", "cm", "mm", "apple", "liter",
    "loss", "yard", "pure", "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre",
    "meter", "inch",
)
ANY_UNIT = r"(^|\W)(" + "|".join(u + "s?" for u in dict.fromkeys(UNITS)) + r")($|\W)"
STRICT_UNITS = (
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot",
    "feet", "inch", "yard", "liter",
)
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
    "billion": 1000000000,
}
AFTER_MARKERS = ("answer:", "answer is", "answers are")
BEFORE_MARKERS = ("is answer", "is the answer", "are answers", "are the answers")
VERB_MARKERS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def pipe(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps in turn, each on a bound variable."""
    def bind(v, step):
        # an array lambda with a second parameter would receive the index
        return let(v, lambda x: step(x))

    for step in steps:
        value = bind(value, step)
    return value


def sub(pattern: str, replacement: str = "") -> Callable[[Column], Column]:
    return lambda s: F.regexp_replace(s, pattern, replacement)


def drop(*parts: str) -> Callable[[Column], Column]:
    def run(s):
        for p in parts:
            s = replace(s, p)
        return s

    return run


def swap(*pairs: tuple[str, str]) -> Callable[[Column], Column]:
    def run(s):
        for old, new in pairs:
            s = replace(s, old, new)
        return s

    return run


def after_last(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, -1)


def before_first(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def last_match(s: Column, pattern: str, group: int = 0) -> Column:
    """Last match of a pattern, null without one."""
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), F.lit(-1))


def count_of(s: Column, part: str) -> Column:
    return (F.length(s) - F.length(replace(s, part))) / F.lit(len(part))


def rstrip(s: Column, chars: str) -> Column:
    return F.rtrim(s, F.lit(chars))


# ------------------------------------------------------------------ boxed answers

def last_boxed_in_tail(text: Column) -> Column:
    """Last boxed expression, at most two brace levels deep, in the end of the text."""
    return last_match(F.right(text, F.lit(BOXED_TAIL)), BOXED_NESTED)


def balanced_end(s: Column) -> Column:
    """Length up to the brace that brings the depth back to zero; null when none does.

    Only the braces are folded over; the lengths of the pieces between them give the place.
    """
    braces = F.filter(F.split(F.regexp_replace(s, r"[^{}]", ""), ""), lambda b: b != "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("at"))

    def add(acc, b):
        depth = acc["depth"] + F.when(b == "{", 1).otherwise(-1)
        seen = acc["seen"] + 1
        hit = (acc["at"] == 0) & (b == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.when(hit, seen).otherwise(acc["at"]).alias("at"))

    closing = F.aggregate(braces, zero, add, lambda acc: acc["at"])

    def length_to(k):
        pieces = F.slice(F.split(s, r"[{}]"), F.lit(1), k)
        return F.when(k > 0, F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p)) + k)

    return let(closing, length_to)


def last_boxed(text: Column) -> Column:
    """Last \\boxed or \\fbox expression with any nesting, or the text after a bare "\\boxed "."""
    bare = F.concat(F.lit("\\boxed "), before_first(after_last(text, "\\boxed "), "$"))

    def from_mark(mark):
        return lambda t: let(
            F.concat(F.lit(mark), after_last(t, mark)), lambda s: F.left(s, balanced_end(s))
        )

    return F.when(has(text, "\\boxed "), bare).when(has(text, "\\boxed"), let(text, from_mark("\\boxed"))).when(
        has(text, "\\fbox"), let(text, from_mark("\\fbox"))
    )


def unwrap_boxed(s: Column) -> Column:
    """Content of a boxed expression; null when it is not one."""
    inner = F.substring(s, 8, 2147483647)
    return F.when(has(s, "\\boxed "), F.when(s.startswith("\\boxed "), inner)).when(
        s.startswith("\\boxed{") & s.endswith("}"), F.left(inner, F.length(inner) - 1)
    )


def boxed_content(text: Column) -> Column:
    """Trimmed content of the last box (any nesting), null without one."""
    def inside(mark):
        def run(t):
            tail = after_last(t, mark)
            return let(tail, lambda s: strip(F.regexp_replace(F.left(s, balanced_end(s) - 1), r"(?s)^[^{]*\{", "")))

        return run

    return F.when(has(text, "\\boxed"), let(text, inside("\\boxed"))).when(
        has(text, "\\fbox"), let(text, inside("\\fbox"))
    )


def find_box(text: Column) -> Column:
    """What follows the last "boxed": its braces' content, or the text before a dollar sign."""
    def run(ans):
        rest = F.substring(ans, 2, 2147483647)
        inside = F.coalesce(F.left(rest, balanced_end(ans) - 2), rest)
        return F.when(ans.startswith("{"), inside).otherwise(strip(before_first(ans, "$")))

    return let(after_last(text, "boxed"), run)


# ------------------------------------------------------------------ normalisers

def word_number(s: Column) -> Column:
    """Number words to digits; texts without one stay as they are.

    Words outside the vocabulary are ignored, a scale word may occur once, and digits
    after "point" are decimals.
    """
    vocab = F.create_map(*[x for w, v in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(v).cast("bigint"))])
    words = F.split(strip(F.lower(replace(s, "-", " "))), r"\s+")
    known = F.filter(words, lambda w: w.isin("point", *NUMBER_WORDS))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"), F.lit("").alias("dec"), F.lit(False).alias("point"))

    def add(acc, w):
        v = F.try_element_at(vocab, w)
        scale = v >= 1000
        total = F.when(scale, acc["total"] + F.greatest(acc["part"], F.lit(1)) * v).otherwise(acc["total"])
        part = F.when(scale, 0).when(v == 100, F.greatest(acc["part"], F.lit(1)) * 100).otherwise(acc["part"] + v)
        is_point = w == "point"
        frozen = acc["point"] | is_point
        return F.struct(
            F.when(frozen, acc["total"]).otherwise(total).cast("bigint").alias("total"),
            F.when(frozen, acc["part"]).otherwise(part).cast("bigint").alias("part"),
            F.when(acc["point"] & ~is_point, F.concat(acc["dec"], v.cast("string"))).otherwise(acc["dec"]).alias("dec"),
            frozen.alias("point"),
        )

    def read(ws):
        once = F.lit(True)
        for w in ("thousand", "million", "billion", "point"):
            once = once & (F.size(F.filter(ws, lambda x: x == w)) <= 1)
        value = F.aggregate(ws, zero, add, lambda a: F.concat((a["total"] + a["part"]).cast("string"), F.when(a["dec"] != "", F.concat(F.lit("."), a["dec"])).otherwise(F.lit(""))))
        only_point = F.size(F.filter(ws, lambda x: x != "point")) == 0
        return F.when((F.size(ws) > 0) & once & ~only_point, value)

    return F.when(s.rlike(r"^\d+$"), F.regexp_replace(s, r"^0+(?=\d)", "")).otherwise(F.coalesce(let(known, read), s))


def fix_fractions(s: Column, fail: Column | None = None) -> Column:
    r"""\frac12 to \frac{1}{2}; a bare numerator with nothing after it leaves the text alone."""
    parts = F.slice(F.split(s, r"\\frac"), F.lit(2), F.greatest(F.size(F.split(s, r"\\frac")) - 1, F.lit(0)))
    short = F.exists(parts, lambda p: ~p.startswith("{") & (F.length(p) < 2))
    fixed = F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    fixed = F.regexp_replace(fixed, r"\\frac([^{])\{", r"\\frac{$1}{")
    out = F.when(short, s).otherwise(fixed)
    if fail is not None:
        return F.when(F.exists(parts, lambda p: p == ""), fail).otherwise(out)
    return out


_PLAIN_INT = r"^(0|-?[1-9][0-9]*)$"


def slash_to_fraction(s: Column) -> Column:
    """a/b of two plain integers (or square roots) to a LaTeX fraction."""
    parts = F.split(s, "/")

    def fine(p):
        return p.rlike(_PLAIN_INT) | has(p, "sqrt")

    whole = F.concat(F.lit("\\frac{"), F.get(parts, F.lit(0)), F.lit("}{"), F.get(parts, F.lit(1)), F.lit("}"))
    return F.when((F.size(parts) == 2) & fine(F.get(parts, F.lit(0))) & fine(F.get(parts, F.lit(1))), whole).otherwise(s)


def drop_short_left_side(s: Column) -> Column:
    """Right side of "k = ..." when the left side has at most two characters."""
    parts = F.split(s, "=")
    return F.when((F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) <= 2), F.get(parts, F.lit(1))).otherwise(s)


_PLAIN_UNIT = re.compile(r"\w+")


def _unit_signs() -> list[Column]:
    """For each unit in order: the unit, whether it has letters only, and what a text must hold for it to match.

    A dot in a unit is a wildcard, so such a unit is told by what stands before the dot.
    """
    signs = []
    for unit in (*UNITS, *[u + "s" for u in UNITS]):
        plain = _PLAIN_UNIT.fullmatch(unit) is not None
        sign = f" {unit} " if plain else unit.split(".")[0]
        signs.append(F.struct(F.lit(unit).alias("unit"), F.lit(plain).alias("plain"), F.lit(sign).alias("sign")))
    return signs


def drop_units(s: Column) -> Column:
    """Remove unit words that stand alone, in list order, twice; never to an empty text.

    Dropping words makes no new ones, so only units that the text has at first are looked at.
    """
    signs = F.array(*_unit_signs())

    def one(acc, x):
        out = F.regexp_replace(acc, F.concat(F.lit(r"(?U)(^|\W)"), x["unit"], F.lit(r"($|\W)")), F.lit("$1$2"))
        return let(out, lambda t: F.when(t != "", t).otherwise(acc))

    def twice(p):
        there = F.filter(signs, lambda x: F.when(x["plain"], F.contains(p["words"], x["sign"])).otherwise(F.contains(p["t"], x["sign"])))
        return let(F.struct(p["t"].alias("t"), there.alias("u")), lambda q: let(
            F.aggregate(q["u"], q["t"], one), lambda t: F.aggregate(q["u"], t, one)))

    words = F.concat(F.lit(" "), F.regexp_replace(s, r"(?U)\W", " "), F.lit(" "))
    # one scan for any unit spares the loop for most answers
    return F.when(s.rlike("(?U)" + ANY_UNIT), let(F.struct(s.alias("t"), words.alias("words")), twice)).otherwise(s)


def normalise(s: Column, skip_unit: bool = False) -> Column:
    """Long answer normaliser of the benchmark toolkit."""
    def text_tail(t):
        cut = strip(F.regexp_replace(t, r"\\text\{.*?\}$", ""))
        return F.when(cut != "", cut).otherwise(t)

    def infinity(t):
        return F.when(has(t, "\\infty"), t).otherwise(replace(t, "inf", "\\infty"))

    def imaginary(t):
        return F.when(has(t, "j") & ~has(t, "i"), replace(t, "j", "i")).otherwise(t)

    def ending(t):
        done = pipe(
            t,
            lambda x: F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x),
            drop_short_left_side,
            sub(r"\\sqrt(\w+)", r"\\sqrt{$1}"),
            drop(" "),
            fix_fractions,
            slash_to_fraction,
        )
        return F.when(t == "", t).otherwise(done)

    steps = [
        lambda t: replace(rstrip(replace(strip(t), "\n"), "."), "\\!"),
        sub(r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"),
        sub(r"\\end\{array\}", r"\\end{pmatrix}"),
        swap(("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")),
        drop("\\left", "\\right"),
        swap(("\\{", "{"), ("\\}", "}")),
        text_tail,
    ]
    if not skip_unit:
        steps.append(drop_units)
    steps += [
        drop("^{\\circ}", "^\\circ", "\\$", "$", "\\(", "\\)"),
        word_number,
        sub(r"\\text\{(.*?)\}", "$1"),
        drop("x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"),
        swap(("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}")),
        drop("\\%", "%"),
        swap((" .", " 0."), ("{.", "{0."), ("infinity", "\\infty")),
        infinity,
        swap(("+\\inity", "\\infty")),
        drop("and", "\\mathbf"),
        sub(r"\\mbox\{.*?\}"),
        imaginary,
        sub(r"(\d+)\.0*([^\d])", "$1$2"),
        sub(r"(\d+)\.0*$", "$1"),
        ending,
    ]
    return pipe(s, *steps)


def normalise_short(s: Column) -> Column:
    """Short normaliser of the competition harness; null where that one gives up."""
    units = "\\text{ "

    def right_units(t):
        return F.when(count_of(t, units) > 1, F.lit(None).cast("string")).otherwise(before_first(t, units))

    def roots(t):
        bare = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
        stuck = t.rlike(r"\\sqrt($|\\sqrt)")
        return F.when(stuck, F.lit(None).cast("string")).otherwise(bare)

    def slash(t):
        parts = F.split(t, "/")
        a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        number = r"^[+-]?[0-9]+(_[0-9]+)*$"
        plain = a.rlike(_PLAIN_INT) & b.rlike(_PLAIN_INT)
        frac = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
        return F.when(F.size(parts) != 2, t).when(plain, frac).when(a.rlike(number) & b.rlike(number), t)

    def ending(t):
        done = pipe(
            t,
            lambda x: F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x),
            drop_short_left_side,
            roots,
            drop(" "),
            lambda x: fix_fractions(x, F.lit(None).cast("string")),
            lambda x: F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x),
            slash,
        )
        return F.when(t == "", t).otherwise(done)

    return pipe(
        s,
        drop("\n", "\\!"),
        swap(("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac")),
        drop("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"),
        right_units,
        drop("\\%"),
        swap((" .", " 0."), ("{.", "{0.")),
        ending,
    )


def same_after_short(a: Column, b: Column) -> Column:
    """Equal after the short normaliser, or as written when it gives up; two nulls match."""
    na, nb = normalise_short(a), normalise_short(b)
    compared = F.when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise(a == b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(compared)


def boxed_score(solution: Column, truth: Column) -> Column:
    """1 when the last boxed answer equals the truth after the short normaliser."""
    answer = unwrap_boxed(last_boxed(solution))
    return F.when(answer.isNotNull() & same_after_short(answer, truth), 1.0).otherwise(0.0)


def strip_group_commas(s: Column) -> Column:
    """Drop thousands commas until nothing changes; one pass per comma is enough."""
    commas = F.array_repeat(F.lit(0), (F.length(s) - F.length(replace(s, ","))).cast("int"))
    return let(commas, lambda cs: F.aggregate(cs, s, lambda acc, _: F.regexp_replace(acc, r"(\d),(\d\d\d)($|\D)", "$1$2$3")))


def as_number(s: Column) -> Column:
    """The text as a double when it is a plain number, else null."""
    return F.when(s.rlike(FLOAT_TEXT), F.btrim(s, F.lit(SPACES)).try_cast("double"))


def _int_text(x: Column) -> Column:
    return x.cast("decimal(38,0)").cast("string")


def is_whole(x: Column) -> Column:
    return F.coalesce(F.abs(x - F.round(x, 0)) <= 1e-7, F.lit(False))


def normalise_strict(s: Column) -> Column:
    """Strict normaliser: text wrapper, money, percent, magnitudes, units, mixed numbers, integers, case."""
    def wrapper(t):
        inner = F.regexp_extract(t, r"^\\text\{(.+?)\}$", 1)
        return F.when(inner != "", inner).otherwise(t)

    def braces(t):
        return F.when(t.startswith("{") & t.endswith("}") & (F.length(t) > 1), F.substring(t, 2, 2147483647).substr(F.lit(1), F.length(t) - 2)).otherwise(t)

    def whole(t):
        x = as_number(t)
        return F.when(is_whole(x), _int_text(F.round(x, 0))).otherwise(t)

    def latex(t):
        plain = pipe(
            t,
            swap(("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac")),
            sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2"),
            sub(r"\\sqrt\{([^{}]*)\}", "sqrt($1)"),
            swap(("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")),
            strip,
        )
        return F.when(has(t, "\\"), plain).otherwise(t)

    def integer(t):
        x = as_number(strip_group_commas(t))
        return F.when(is_whole(x), _int_text(F.bround(x, 0))).otherwise(t)

    def units(t):
        for u in STRICT_UNITS:
            t = F.regexp_replace(t, rf"{u}(es)?(s)? *(\^[0-9]+)?", "")
        return t

    return pipe(
        s,
        wrapper,
        swap(("\\%", "%"), ("\\$", "$")),
        drop("$", "%"),
        swap((" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")),
        units,
        sub(r"\^ *\\circ"),
        braces,
        sub(r",\\! *"),
        whole,
        latex,
        sub("- *", "-"),
        sub("([0-9]) +([0-9])", r"$1+$2"),
        F.lower,
        integer,
    )


def split_tuple(s: Column) -> Column:
    """Elements of a tuple or interval; anything else is its own only element."""
    def run(t):
        body = t.substr(F.lit(2), F.length(t) - 2)
        framed = t.rlike(r"(?s)^[()\[\]].+[()\[\]]$") & ~body.rlike(r"[()\[\]]")
        parts = F.transform(F.split(body, ","), strip)
        return F.when(t == "", F.array().cast("array<string>")).when(framed, parts).otherwise(F.array(t))

    return let(strip_group_commas(s), run)


_FRACTION = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"


def grade_strict(given: Column, truth: Column) -> Column:
    """Strict grade on normalised text: brackets and arity must agree, fractions must be
    written alike, integers must meet integers; elements are equal as text or as numbers."""
    wrapped = r"^\\text\{(.+?)\}$"

    def light(c):
        def body(t):
            inner = F.regexp_extract(t, wrapped, 1)
            return F.when(inner != "", strip(inner)).otherwise(t)

        return let(strip(c), lambda t: F.coalesce(normalise_short(body(t)), body(t)))

    def element(g, t):
        x, y = as_number(strip_group_commas(g)), as_number(strip_group_commas(t))
        both_fractions = g.rlike(_FRACTION) & t.rlike(_FRACTION)
        alike = (g == t) | F.coalesce(x == y, F.lit(False))
        return F.when(both_fractions, g == t).when(is_whole(x) != is_whole(y), F.lit(False)).otherwise(alike)

    def deep(p):
        g, t = p["g"], p["t"]

        def compare(e):
            frames = (F.left(g, F.lit(1)) == F.left(t, F.lit(1))) & (F.right(g, F.lit(1)) == F.right(t, F.lit(1)))
            pairs = F.zip_with(e["g"], e["t"], element)
            return F.when((F.size(e["t"]) > 1) & ~frames, F.lit(False)).when(
                F.size(e["g"]) != F.size(e["t"]), F.lit(False)
            ).otherwise(F.forall(pairs, lambda ok: ok))

        split = F.struct(split_tuple(g).alias("g"), split_tuple(t).alias("t"))
        return F.when(g == t, F.lit(True)).when(g == "", F.lit(False)).otherwise(let(split, compare))

    strict = F.struct(normalise_strict(given).alias("g"), normalise_strict(truth).alias("t"))
    full = F.coalesce(light(given) == light(truth), F.lit(False)) | F.coalesce(let(strict, deep), F.lit(False))
    return F.when(given.isNull() | truth.isNull(), F.lit(False)).otherwise(full)


# ------------------------------------------------------------------ extraction

def choice_answer(text: Column) -> Column:
    """Choice letter: first after a trigger phrase, else the last one; else the cleaned text."""
    trigger = "|".join(TRIGGERS)

    def first_chunk(t):
        many = (count_of(t, TRIGGERS[0]) > 1) | (count_of(t, TRIGGERS[1]) > 1)
        return F.when(many, before_first(t, "\n\n")).otherwise(t)

    def pick(t):
        parts = F.split(t, trigger)
        flagged = F.size(parts) > 1
        body = F.try_element_at(parts, F.lit(-1))
        clean = F.ltrim(F.btrim(rstrip(rstrip(F.btrim(body, F.lit("\n")), "."), "/"), F.lit(" ")), F.lit(":"))

        def letter(b):
            found = F.regexp_extract_all(F.upper(b), F.lit(r"(?U)\b([A-E])\b"), F.lit(1))
            chosen = F.when(flagged, F.get(found, F.lit(0))).otherwise(F.try_element_at(found, F.lit(-1)))
            return F.coalesce(chosen, F.btrim(strip(b), F.lit(".")))

        return let(clean, letter)

    return pipe(F.btrim(text, F.lit("\n")), first_chunk, pick, lambda t: rstrip(rstrip(t, "."), "/"))


def last_choice(text: Column) -> Column:
    """Last choice letter of a text, else the cleaned text (the comparer's shorter form)."""
    def pick(b):
        letter = last_match(F.upper(b), r"(?U)\b([A-E])\b", 1)
        return F.coalesce(letter, F.btrim(strip(b), F.lit(".")))

    body = F.ltrim(F.btrim(rstrip(rstrip(F.btrim(text, F.lit("\n")), "."), "/"), F.lit(" ")), F.lit(":"))
    return let(let(body, pick), lambda t: rstrip(rstrip(t, "."), "/"))


def multi_choice(text: Column) -> Column:
    """Upper-case letter after "answer is", or the word placeholder."""
    body = F.lower(replace(before_first(text, "Problem:"), "choice is", "answer is"))
    letter = F.regexp_extract(body, r"answer is \(?([abcde])\)?", 1)
    return F.when(letter != "", F.upper(letter)).otherwise(F.lit("placeholder"))


def last_number(text: Column) -> Column:
    return F.coalesce(last_match(text, NUMBER), F.lit(""))


def extract_answer(text: Column, data_name: str, use_last_number: bool = True) -> Column:
    """Answer ladder: choice sets, template phrase, box, "answer is" phrases, last number."""
    clean = replace(text, "\u043a\u0438")
    if data_name in CHOICE_SETS:
        return choice_answer(clean)

    def ladder(t):
        template = strip(before_first(F.get(F.split(t, r"final answer is \$", 2), F.lit(1)), "$. I hope"))
        chinese = strip(before_first(strip(F.get(F.split(t, "答案是"), F.lit(1))), "\n\n"))
        fallback = last_number(replace(t, ",")) if use_last_number else F.lit("")
        return (
            F.when(has(t, "final answer is $") & has(t, "$. I hope"), template)
            .when(has(t, "boxed"), find_box(t))
            .when(has(t, "he answer is"), strip(after_last(t, "he answer is")))
            .when(has(t, "final answer is"), strip(after_last(t, "final answer is")))
            .when(has(t, "答案是"), chinese)
            .otherwise(fallback)
        )

    steps = [ladder]
    if data_name in ("sat_math", "aqua") or "mmlu" in data_name:
        steps.append(lambda t: F.coalesce(last_match(F.upper(t), r"(?U)\b([A-E])\b", 1), F.btrim(strip(t), F.lit("."))))
    steps += [
        sub(r"\n\s*"), sub(r"\A:"), sub(r"\.\z"), sub(r"/\z"),
        lambda t: normalise(t, skip_unit=data_name in UNIT_EXCEPTIONS),
    ]
    return pipe(clean, *steps)


def prediction_for(result: Column, data_name: str) -> Column:
    """Prediction of a generation: extracted and normalised again; null for an empty or failed one."""
    again = let(extract_answer(result, data_name), lambda t: normalise(t, skip_unit=data_name in UNIT_EXCEPTIONS))
    return F.when(result.isNull() | result.isin("", "error"), F.lit(None).cast("string")).otherwise(again)


def clean_units(text: Column) -> Column:
    """pi to 3.14, percent to a division, currency and degree signs dropped."""
    return pipe(
        text,
        swap(("\\pi", "π")),
        sub(r"(?<![\d}])\\?π", "3.14"),
        sub(r"(\d)(\\?π)", "$1*3.14"),
        sub(r"\{(\\?π)\}", "3.14"),
        sub(r"\*(\\?π)", "*3.14"),
        swap(("%", "/100")),
        drop("$", "¥", "°C", " C", "°"),
    )


def theorem_answer(text: Column, answer_flag: bool = True) -> Column:
    """True/False words, option letters, else box, last side of an equation, number before a unit."""
    low = F.lower(text)

    def open_ended(t):
        boxed = F.when(has(t, "boxed"), find_box(t)).otherwise(t)
        if not answer_flag:
            return let(boxed, last_number)

        def number_first(x):
            unit = x.rlike(r"^-?[\d\.]+\s\D+$") | x.rlike(r"^-?[\d\.]+\s[^\s]+$")
            return F.when(unit, before_first(x, " ")).otherwise(x)

        return pipe(boxed, lambda x: clean_units(strip(after_last(x, "="))), number_first)

    return (
        F.when(low.rlike("yes|true"), F.lit("True")).when(low.rlike("no|false"), F.lit("False"))
        .when(low.rlike(r"\([a-f]\)"), text).otherwise(let(text, open_ended))
    )


def match_answer(text: Column) -> Column:
    """(matched, answer): phrase after or before a marker, box, last sentence, last verb.

    Without a digit in what is left nothing is matched.
    """
    def state(m, r):
        return F.struct(m.alias("m"), r.alias("r"))

    def cut(mark, after):
        def run(s):
            r = s["r"]
            tail = after_last(F.lower(r), mark)
            hit = has(F.lower(r), mark)
            kept = F.right(r, F.length(tail)) if after else F.left(r, F.length(r) - F.length(tail) - len(mark))
            return state(s["m"] | hit, F.when(hit, strip(kept)).otherwise(r))

        return run

    def box(s):
        return let(boxed_content(s["r"]), lambda b: F.when(F.coalesce(b, F.lit("")) != "", state(F.lit(True), b)).otherwise(s))

    def sentence(s):
        r = s["r"]
        kept = strip(F.left(r, F.length(r) - F.length(after_last(r, ". ")) - 2))
        return state(s["m"], F.when(has(r, ". "), kept).otherwise(r))

    steps = [cut(m, True) for m in AFTER_MARKERS] + [cut(m, False) for m in BEFORE_MARKERS]
    steps += [box, sentence] + [cut(m, True) for m in VERB_MARKERS]
    end = pipe(state(F.lit(False), text), *steps)
    return let(end, lambda s: F.struct((s["m"] & s["r"].rlike(r"\d")).alias("matched"), s["r"].alias("answer")))


def trim_transcript(text: Column) -> Column:
    """From the first assistant marker on, up to the first stop word."""
    def stop(word):
        return lambda t: F.when(has(t, word), strip(before_first(t, word))).otherwise(t)

    start = F.regexp_replace(text, r"(?s)\A.*?<\|im_start\|>assistant", LAST_TURN)
    return pipe(start, *[stop(word) for word in STOP_WORDS])


def hash_answer(text: Column, method: str = "strict") -> Column:
    """Number after "#### " (strict) or the last number-like run that is not a dot (flexible)."""
    if method == "strict":
        found = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
        return F.when(text.rlike(r"#### -?[0-9.,]+"), F.replace(replace(found, ","), F.lit("$"), F.lit("")))
    if method != "flexible":
        raise ValueError(f"unknown method {method!r}")
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.get(found, F.lit(0)))


def hash_score(text: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = hash_answer(text, method)
    return F.when(answer.isNull(), 0.0).when(answer == truth, F.lit(score)).otherwise(F.lit(format_score))


THINK_FORMAT = r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"


def think_score(text: Column, truth: Column) -> Column:
    """0.9 for the answer and 0.1 for the thinking format."""
    accuracy = F.when(grade_strict(boxed_content(text), truth), 1.0).otherwise(0.0)
    form = F.when(text.rlike(THINK_FORMAT), 1.0).otherwise(0.0)
    return F.lit(0.9) * accuracy + F.lit(0.1) * form


# ------------------------------------------------------------------ equality ladder

def parse_digits(s: Column) -> Column:
    """Number without commas; a trailing percent sign (escaped or not) divides by 100."""
    def run(t):
        bare = rstrip_once(rstrip_once(t, "%"), "\\")
        return F.coalesce(as_number(t), F.when(t.endswith("%"), as_number(bare) / 100))

    return let(replace(s, ","), run)


def rstrip_once(s: Column, tail: str) -> Column:
    return F.when(s.endswith(tail), F.left(s, F.length(s) - len(tail))).otherwise(s)


REL_TOL = 1e-4


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= REL_TOL * F.greatest(F.abs(a), F.abs(b))


def numeric_match(a: Column, b: Column, include_percentage: bool = True, is_close: bool = True) -> Column:
    """Equal to the reference, or to its hundredth or hundredfold; null unless both are numbers."""
    same = close if is_close else (lambda x, y: x == y)

    def run(p):
        a_, b_ = p["a"], p["b"]
        hit = same(a_, b_)
        if include_percentage:
            hit = same(a_, b_ / 100) | hit | same(a_, b_ * 100)
        return hit

    return let(F.struct(parse_digits(a).alias("a"), parse_digits(b).alias("b")), run)


def set_to_matrix(s: Column) -> Column:
    """Set texts such as {a,b} to matrix text."""
    found = F.regexp_extract_all(strip(s), F.lit(r"\{.*,.*\}"), F.lit(0))
    rows = F.transform(found, lambda m: F.concat(
        F.lit("\\begin{pmatrix}"), F.replace(F.btrim(m, F.lit("{}")), F.lit(","), F.lit("\\")), F.lit("\\end{pmatrix}")
    ))
    return F.array_join(rows, ", ")


def _equal_flat(p: Column, r: Column) -> Column:
    """Case-folded text, choice letter, number, then text without brackets."""
    def run(x):
        a, b = x["p"], x["r"]
        letter = b.isin("A", "B", "C", "D", "E") & (last_choice(a) == b)
        number = numeric_match(a, b)
        square = a.startswith("[") & a.endswith("]") & ~b.startswith("(")
        round_ = a.startswith("(") & a.endswith(")") & ~b.startswith("[")
        unframed = square | round_
        bare_a = F.when(unframed, F.btrim(a, F.lit("[]()"))).otherwise(a)
        bare_b = F.when(unframed, F.btrim(b, F.lit("[]()"))).otherwise(b)
        same = F.lower(F.translate(bare_a, "{}()", "")) == F.lower(F.translate(bare_b, "{}()", ""))
        return (F.lower(strip(a)) == F.lower(strip(b))) | letter | F.coalesce(number, (a != "") & same)

    return let(F.struct(p.alias("p"), r.alias("r")), run)


def _all_equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(_equal_flat(x, y), F.lit(False))), lambda ok: ok)


_PAIR = r"(?s)^[(\[].+[)\]]"
_MATRIX = r"(?s)^\\begin\{[pb]matrix\}.*\\end\{[pb]matrix\}$"


def math_equal(prediction: Column, reference: Column) -> Column:
    """The textual and numeric rungs: flat equality, element by element for tuples and
    matrices, and one side of an equation against a plain value."""
    def inner(s):
        return F.split(s.substr(F.lit(2), F.length(s) - 2), ",")

    def rows(s):
        body = s.substr(F.lit(16), F.length(s) - 28)
        lines = F.transform(F.split(body, r"\\\\"), strip)
        return F.filter(lines, lambda x: x != "")

    def matrix(a, b):
        cells = F.zip_with(rows(a), rows(b), lambda x, y: _all_equal(F.split(x, "&"), F.split(y, "&")))
        return a.rlike(_MATRIX) & b.rlike(_MATRIX) & (F.size(rows(a)) == F.size(rows(b))) & F.forall(cells, lambda ok: ok)

    def one_side(s):
        parts = F.split(s, "=")
        return F.when((F.size(parts) == 2) & (F.length(strip(F.get(parts, F.lit(0)))) <= 2), F.get(parts, F.lit(1)))

    def run(x):
        a, b = x["p"], x["r"]
        flat = _equal_flat(a, b)
        decided = numeric_match(a, b).isNotNull()

        def deeper(y):
            p, r = y["p"], y["r"]
            pairs = p.rlike(_PAIR) & r.rlike(_PAIR) & _all_equal(inner(p), inner(r))
            plain_r, plain_p = ~has(r, "="), ~has(p, "=")
            sides = F.when(plain_r, _equal_flat(one_side(p), r)).when(plain_p, _equal_flat(p, one_side(r)))
            return (p != "") & (pairs | matrix(p, r) | F.coalesce(sides, F.lit(False)))

        ref = F.when(has(a, "pmatrix") & ~has(b, "pmatrix"), set_to_matrix(b)).otherwise(strip(b))
        return F.when(flat, F.lit(True)).when(decided, F.lit(False)).otherwise(
            let(F.struct(strip(a).alias("p"), ref.alias("r")), deeper)
        )

    equal = F.coalesce(let(F.struct(prediction.alias("p"), reference.alias("r")), run), F.lit(False))
    return F.when(prediction.isNull() | reference.isNull(), F.lit(False)).otherwise(equal)


def loose_number(s: Column, allow_percent: bool) -> Column:
    """Number without commas and dollar signs; a percent value is divided by 100 if allowed."""
    def run(t):
        value = as_number(t)
        if allow_percent:
            value = F.when(t.endswith("%"), as_number(rstrip(t, "%")) / 100).otherwise(value)
        return value

    return let(replace(replace(s, ","), "$"), run)


def rough_match(generation: Column, answer: Column) -> Column:
    """1 when a word of the last line with a digit equals the answer within 1e-3.

    Words next to an operator do not count, nor words that hold an equals sign at or after
    the place in them that has their own index.
    """
    operators = ("+", "-", "*", "/", "^")

    def scan(x):
        line = F.coalesce(F.try_element_at(F.filter(F.split(x["g"], "\n"), lambda t: t.rlike(r"\d")), F.lit(-1)), before_first(x["g"], "\n"))
        words = F.filter(F.split(line, r"\s+"), lambda w: w != "")

        def over(ws):
            good = F.transform(ws["w"], lambda w, i: (
                ~F.coalesce(F.get(ws["w"], i - 1).isin(*operators), F.lit(False))
                & ~F.coalesce(F.get(ws["w"], i + 1).isin(*operators), F.lit(False))
                & w.rlike(r"\d")
                & F.coalesce(F.abs(loose_number(w, True) - ws["a"]) < 1e-3, F.lit(False))
                & ~has(w.substr(i + 1, F.length(w)), "=")
            ))
            return F.when(F.exists(good, lambda ok: ok), 1).otherwise(0)

        return let(F.struct(words.alias("w"), loose_number(x["a"], False).alias("a")), over)

    return let(F.struct(generation.alias("g"), answer.alias("a")), scan)


def percent_to_fraction(text: Column) -> Column:
    """Every percentage replaced by its value, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(\.\d+)?%)"), F.lit(1))
    return F.aggregate(
        found, text,
        lambda acc, m: F.replace(acc, m, (F.rtrim(m, F.lit("%")).cast("double") / 100).cast("string")),
    )


def number_in(text: Column) -> Column:
    """Last number of a sentence without commas, empty when there is none."""
    return F.coalesce(last_match(replace(text, ","), r"-?\d+\.?\d*"), F.lit(""))


def clean_expression(text: Column) -> Column:
    """Operators and symbols of an expression in one spelling."""
    return pipe(
        text,
        swap((" . ", "."), (". ", "."), ("**", "^"), ("\\pm", ""), ("*", "\\times "), ("\\\\", "\\"), ("\\ne ", "\\neq "),
             ("!=", "\\neq"), (">=", "\\ge"), ("<=", "\\le"), ("≠", "\\neq"), ("dfrac", "frac"), ("tfrac", "frac")),
        drop("\\$", "$", "\\%", "%", "\\!"),
        swap(("^\\circ", "\\times \\pi / 180"), ("//", "/"), ('"', "")),
        sub(r"\\+", r"\\"),
        sub(r"\^\s?\((.*?)\)", r"^{$1}"),
        sub(r"\\frac\s?(\d)\s?(\d+)", r"\\frac{$1}{$2}"),
        sub(r"\\log_\s?(\d)\s?(\d+)", r"\\log_{$1}{$2}"),
        sub(r"\\frac\s?\{(.*?)\}\s?(\d)", r"\\frac{$1}{$2}"),
        sub(r"\\frac\s?(\d)\s?\{(.*?)\}", r"\\frac{$1}{$2}"),
        sub(r"\\sqrt\s?(\d)", r"\\sqrt{$1}"),
        sub(r"sqrt\s?\((\d+)\)", r"\\sqrt{$1}"),
        sub(r"sqrt\s?\((.*?)\)", r"\\sqrt{$1}"),
        swap((" sqrt", "\\sqrt")),
        drop("\\left", "\\right.", "\\right"),
    )


def same_expression(a: Column, b: Column) -> Column:
    """Equal after the clean-up, spaces and commas aside."""
    def bare(c):
        return F.translate(clean_expression(c), ",$ ", "")

    return bare(a) == bare(b)


def normalise_number(s: Column, pi: float = 3.141592653589793) -> Column:
    """Money, percent, base suffix and pi before comparing; a pi text that is a product of
    numbers becomes its value."""
    def pi_text(t):
        spelled = F.regexp_replace(F.regexp_replace(t, r"([0-9])\\pi", rf"$1*{pi}"), r"\\pi", f"1*{pi}")

        def value(x):
            factors = F.split(x, r"\*")
            numbers = F.transform(factors, as_number)
            product = F.aggregate(numbers, F.lit(1.0), lambda acc, n: acc * n)
            return F.coalesce(product.cast("string"), x)

        return F.when(has(t, "\\pi"), let(spelled, value)).otherwise(t)

    def base(t):
        number = as_number(before_first(t, "_"))
        return F.when(has(t, "_"), F.when(number.isNotNull(), number.cast("decimal(38,0)").cast("string"))).otherwise(t)

    money = F.substring(s, 2, 2147483647)
    percent = s.rlike(r"^\d+(\.\d+)?\\?%$")
    return F.when(s.rlike(r"^\$\d+(\.\d+)?"), money).when(percent, drop("\\%", "%")(s)).otherwise(
        pipe(s, base, pi_text)
    )


INTERVALS = (("Interval", "[", "]"), ("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"), ("Interval.open", "(", ")"))


def interval_text(s: Column) -> Column:
    """Interval objects to bracket text."""
    out = s
    for name, left, right in INTERVALS:
        pattern = "^" + name.replace(".", r"\.") + r"\((.*)\)$"
        out = F.when(s.rlike(pattern), F.concat(F.lit(left), F.regexp_extract(s, pattern, 1), F.lit(right))).otherwise(out)
    return out
