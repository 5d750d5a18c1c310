"""Preparation of prompt sets, preference pairs and fine-tuning rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as X
from ..functions import arrays as A
from ..functions import templates as P
from ..functions.text import has, replace, strip
from .ordering import first_rows, index_by_id, permuted, seeded_index, shuffle_key

CHAT = "array<struct<role:string,content:string>>"


def rename_problem(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("problem", "prompt") if "problem" in df.columns else df


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_to_chat(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """A text prompt, or the first of a list of texts, as a one-message chat; chats stay."""
    kind = df.schema[prompt].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(prompt, F.array(_message("user", F.col(prompt))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        chat = F.array(_message("user", F.get(prompt, F.lit(0))))
        return df.withColumn(prompt, F.when(F.size(prompt) > 0, chat).otherwise(F.array().cast(CHAT)))
    return df


def fill_defaults(df: DataFrame, dataset: str, ability: str = "math") -> DataFrame:
    """data_source (last part of the dataset name) and ability where a column is missing."""
    base = dataset.split("/")[-1]
    out = df if "data_source" in df.columns else df.withColumn("data_source", F.lit(base))
    return out if "ability" in out.columns else out.withColumn("ability", F.lit(ability))


def add_extra_info(df: DataFrame, id_col: str, split: str) -> DataFrame:
    """extra_info = {index, split}, the index being the row's position in id order."""
    if "extra_info" in df.columns:
        return df
    placed = index_by_id(df, id_col, out="__i")
    return placed.withColumn(
        "extra_info", F.struct(F.col("__i").alias("index"), F.lit(split).alias("split"))
    ).drop("__i")


def truth_to_reward_model(df: DataFrame, gt: str = "gt") -> DataFrame:
    if gt not in df.columns:
        return df
    reward = F.struct(F.col(gt).cast("string").alias("ground_truth"), F.lit("rule").alias("style"))
    return df.withColumn("reward_model", reward).drop(gt)


def prefix_messages(df: DataFrame, instruction: str, prompt: str = "prompt") -> DataFrame:
    """Instruction in front of the content of every message."""
    def put(m):
        return F.struct(m["role"].alias("role"), F.concat(F.lit(instruction), m["content"]).alias("content"))

    return df.withColumn(prompt, F.transform(prompt, put))


def render_chat(prompt: Column, add_generation_prompt: bool = True) -> Column:
    """Chat as one text with role markers."""
    said = F.transform(prompt, lambda m: F.concat(
        F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")
    ))
    tail = "<|im_start|>assistant\n" if add_generation_prompt else ""
    return F.concat(F.array_join(said, ""), F.lit(tail))


def first_message(prompt: Column) -> Column:
    return F.get(prompt, F.lit(0))["content"]


def word_count(text: Column) -> Column:
    """Default tokenizer expression: whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def drop_long_prompts(df: DataFrame, max_length: int, prompt: str = "prompt", tokens=word_count, rendered: bool = True, enabled: bool = True) -> DataFrame:
    """Prompts within the limit: tokens of the rendered chat, or characters of the first message."""
    if not enabled:
        return df
    length = tokens(render_chat(F.col(prompt))) if rendered else F.length(first_message(F.col(prompt)))
    return df.where(length <= max_length)


def sample_per_source(df: DataFrame, source: str, keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows per source, without replacement, in seeded order."""
    cols = df.columns
    keyed = df.withColumn("__digest", shuffle_key(seed, *keys))
    return first_rows(keyed, [source], [F.col("__digest"), *[F.col(k) for k in keys]], size, "__r").select(*cols)


def pull_index(df: DataFrame) -> DataFrame:
    return df.withColumn("index", F.coalesce(F.col("extra_info.index"), F.lit(0).cast("bigint")))


def oversampled_batch_size(batch_size: int, multiplier: float, world_size: int) -> int:
    """Batch size before rejection, rounded down to a multiple of the world size."""
    return int(batch_size * multiplier // world_size * world_size)


def epoch_batches(df: DataFrame, keys: Sequence[str], batch_size: int, epochs: int = 1, seed: int = 1, shuffle: bool = True, drop_last: bool = True) -> DataFrame:
    """Rows of every epoch in (shuffled) order with their batch number; the short last batch goes.

    Sequential order needs one numeric key. The order of an epoch depends on the row
    keys, the epoch number and the seed.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    runs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle:
        placed = seeded_index(runs, [*keys, "epoch"], seed, group_by=["epoch"], out="position")
    else:
        indexed = index_by_id(df, keys[0], out="position")
        placed = indexed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    batched = placed.withColumn("batch_id", F.floor(F.col("position") / batch_size))
    return batched.where(F.col("batch_id") < F.floor(total / batch_size)) if drop_last else batched


def permuted_epochs(df: DataFrame, index: str, n: int, epochs: int, seed: int) -> DataFrame:
    """Rows of every epoch with their ``position`` in a seeded order of it, from a dense index 0..n-1; nothing is sorted."""
    runs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return runs.withColumn("position", permuted(F.col(index), n, F.xxhash64(F.col("epoch"), F.lit(seed))))


def preference_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, max_length: int, eos_id: int, pad_id: int = 0) -> DataFrame:
    """Two padded rows per pair: prompt + chosen and prompt + rejected, each with its own mask."""
    limit = F.lit(max_length)

    def row(name, response):
        ids = F.concat(F.col(prompt), F.col(response), F.array(F.lit(eos_id).cast("bigint")))
        ones = A.repeat_to(F.lit(1), F.size(ids))
        return F.struct(
            F.lit(name).alias("kind"),
            A.pad_right(A.keep_first(ids, limit), F.lit(pad_id).cast("bigint"), limit).alias("input_ids"),
            A.pad_right(A.keep_first(ones, limit), F.lit(0), limit).alias("attention_mask"),
        )

    rest = [c for c in df.columns if c not in (prompt, chosen, rejected)]
    both = F.explode(F.array(row("chosen", chosen), row("rejected", rejected)))
    return df.select(*rest, both.alias("r")).select(*rest, "r.*")


def nested_field(root: str, path: Sequence[str]) -> Column:
    out = F.col(root)
    for key in path:
        out = out.getField(key)
    return out


def fine_tuning_rows(df: DataFrame, prompt: str, response: str, max_length: int, eos_id: int, pad_id: int = 0, truncation: str = "error") -> DataFrame:
    """Ids, attention mask, position ids and loss mask of prompt + response + end token.

    The loss mask leaves out the prompt but for its last token, and the last response
    token; both places count from the uncut lengths.
    """
    limit = F.lit(max_length)
    ids = F.concat(F.col(prompt), F.col(response), F.array(F.lit(eos_id).cast("bigint")))
    staged = df.withColumns({"__ids": ids, "__p": F.size(prompt), "__n": F.size(ids)})
    cut = A.truncate(F.col("__ids"), max_length, truncation)
    staged = staged.withColumn("input_ids", A.pad_right(cut, F.lit(pad_id).cast("bigint"), limit))
    real = F.least(F.col("__n"), limit)
    attention = F.concat(A.repeat_to(F.lit(1), real), A.repeat_to(F.lit(0), limit - real))
    staged = staged.withColumn("attention_mask", attention)
    positions = F.transform("attention_mask", lambda m, i: F.greatest(F.least(i, real - 1), F.lit(0)))
    silent = F.when(F.col("__p") > 1, F.least(F.col("__p"), limit) - 1).otherwise(0)
    last = real - 1
    loss = F.transform("attention_mask", lambda m, i: F.when((i < silent) | (i == last), 0).otherwise(m))
    return staged.withColumns({"position_ids": positions, "loss_mask": loss}).drop("__ids", "__p", "__n")


TAGS = (
    # fixed values: opening tag, closing tag, what the content becomes
    ("<output>", "<end_of_output>", "Code execution result: $1"),
)


def rewrite_tags(text: Column) -> Column:
    """Code tags to fenced blocks, output tags to a result line, answer tags removed.

    Step markers inside code go as well: the text is cut at the closing code tag, and
    only the piece behind an opening tag is cleaned.
    """
    pieces = F.split(text, "<end_of_code>")
    last = F.size(pieces) - 1

    def fence(piece, i):
        body = F.regexp_extract(piece, r"(?s)<code>\s*(.*?)\s*\z", 1)
        head = F.substring_index(piece, "<code>", 1)
        block = F.concat(head, F.lit("```python\n"), replace(body, "<end_of_step>\n"), F.lit("\n```"))
        return F.when((i < last) & has(piece, "<code>"), block).when(i < last, F.concat(piece, F.lit("<end_of_code>"))).otherwise(piece)

    out = F.array_join(F.transform(pieces, fence), "")
    for left, right, becomes in TAGS:
        out = F.regexp_replace(out, rf"(?s){left}\s*(.*?)\s*{right}", becomes)
    return F.regexp_replace(out, r"(?s)<answer>\s*(.*?)\s*<end_of_answer>", "$1")


def to_messages(query: Column, response: Column) -> Column:
    """User and assistant messages; an empty side is left out."""
    both = F.array(_message("user", query), _message("assistant", response))
    return F.filter(both, lambda m: m["content"].isNotNull() & (m["content"] != ""))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def single_answer(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows without several answers."""
    return df.where(~has(F.col(answer), ";"))


def union_tasks(tasks: dict[str, DataFrame]) -> DataFrame:
    """Union of sub-tasks, each with its name as type."""
    out = None
    for name, df in tasks.items():
        typed = df.withColumn("type", F.lit(name))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def keep_subjects(df: DataFrame, subject: str = "subject", subjects: Sequence[str] = P.STEM_SUBJECTS) -> DataFrame:
    return df.withColumnRenamed(subject, "type").where(F.col("type").isin(*subjects))


def ensure_index(df: DataFrame, id_col: str) -> DataFrame:
    """idx when absent (position in id order), rows sorted by it."""
    out = df if "idx" in df.columns else index_by_id(df, id_col, out="idx")
    return out.orderBy("idx")


def _c(df_columns, *names) -> Column:
    present = [F.col(n) for n in names if n in df_columns]
    return present[0] if present else F.lit("")


def _plain_number(answer: Column) -> Column:
    """A quotient, a number with thousands commas, a percentage or a number, as text."""
    parts = F.split(answer, "/")
    ratio = X.as_number(F.get(parts, F.lit(0))) / X.as_number(F.get(parts, F.lit(1)))
    value = F.when(has(answer, "/"), ratio).when(has(answer, ","), X.as_number(replace(answer, ","))).when(
        has(answer, "%"), X.as_number(X.before_first(answer, "%")) / 100
    ).otherwise(X.as_number(answer))
    return value.cast("string")


def _numeric_answer() -> Column:
    is_number = F.col("ans_type").isin("integer_number", "decimal_number")
    return F.when(is_number, _plain_number(F.col("answer"))).otherwise(F.col("answer"))


def _of(column: str) -> Callable[[], Column]:
    return lambda: F.col(column)


def _hash_part(i: int) -> Callable[[], Column]:
    return lambda: F.get(F.split("answer", "####"), F.lit(i))


# name: where the reference solution is (None: there is none), and where the reference answer
_TRUTHS: dict[str, tuple[Callable[[], Column] | None, Callable[[], Column]]] = {
    **{name: (None, _of("answer")) for name in ("aime24", "amc23", "cmath", "gaokao2024_I", "gaokao2024_II", "imo2024")},
    **{name: (None, lambda: strip(replace(F.col("answer"), "$"))) for name in ("college_math", "gaokao2023en", "gaokao_math_cloze")},
    **{name: (None, lambda: F.when(F.length("choice_answer") > 0, F.col("choice_answer")).otherwise(F.col("answer")))
       for name in ("cn_middle_school", "gaokao2024_mix")},
    **{name: (_of("solution"), lambda n=name: X.extract_answer(F.col("solution"), n)) for name in ("math", "minerva_math")},
    "aqua": (None, _of("correct")),
    "asdiv": (_of("formula"), lambda: F.regexp_replace("answer", r"\(.*?\)", "")),
    "carp_en": (_of("steps"), _of("answer")),
    "gaokao_math_qa": (None, _of("label")),
    "gsm8k": (_hash_part(0), _hash_part(1)),
    "mawps": (None, _of("target")),
    "mmlu_stem": (None, lambda: F.substring(F.lit("ABCD"), F.col("answer").cast("int") + 1, F.lit(1))),
    "olympiadbench": (None, lambda: F.btrim(F.get("final_answer", F.lit(0)), F.lit("$"))),
    "sat_math": (None, _of("Answer")),
    "svamp": (_of("Equation"), _of("Answer")),
    "tabmwp": (_of("solution"), _numeric_answer),
}


def ground_truth(df: DataFrame, data_name: str) -> dict[str, Column]:
    """Reference solution and reference answer of a benchmark row, as gt_cot and gt."""
    cols = df.columns
    if "gt_cot" in cols and "gt" in cols:
        if data_name == "math":
            truth = X.extract_answer(F.col("gt_cot"), data_name)
        elif data_name in X.UNIT_EXCEPTIONS:
            truth = F.col("gt")
        else:
            truth = X.normalise(F.col("gt"))
        return {"gt_cot": F.col("gt_cot"), "gt": truth}
    if data_name not in _TRUTHS:
        raise NotImplementedError(f"unknown benchmark {data_name!r}")
    solution, answer = _TRUTHS[data_name]
    cot, truth = F.lit("None") if solution is None else solution(), answer()
    if data_name in X.UNIT_EXCEPTIONS:
        final = X.swap(("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge"))(truth)
    else:
        final = X.normalise(truth)
    return {"gt_cot": strip(cot), "gt": final}


def question_text(df: DataFrame, data_name: str, truth: Column | None = None) -> Column:
    """Question of a benchmark row; yes/no and true/false answers announce themselves."""
    def s(name):
        return strip(F.col(name))

    def lettered(options):
        return F.array_join(F.transform(options, lambda o, i: F.concat(
            F.lit("("), F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), strip(o))), " ")

    if data_name == "asdiv":
        text = F.concat(s("body"), F.lit(" "), s("question"))
    elif data_name == "svamp":
        body = F.when(s("Body").endswith("."), s("Body")).otherwise(F.concat(s("Body"), F.lit(".")))
        text = F.concat(body, F.lit(" "), s("Question"))
    elif data_name == "tabmwp":
        title = F.when(F.coalesce(F.col("table_title"), F.lit("")) != "", F.concat(F.lit('regarding "'), "table_title", F.lit('" '))).otherwise("")
        listed = F.concat(F.lit("['"), F.array_join("choices", "', '"), F.lit("']"))
        options = F.when(F.size("choices") > 0, F.concat(F.lit(" Please select from the following options: "), listed)).otherwise("")
        text = F.concat(F.lit("Read the following table "), title, F.lit("and answer a question:\n"), "table", F.lit("\n"), "question", options)
    elif data_name == "carp_en":
        text = F.col("content")
    elif data_name == "mmlu_stem":
        text = F.concat(s("question"), F.lit("\nAnswer Choices: "), lettered(F.col("choices")))
    elif data_name == "sat_math":
        options = F.concat(F.lit("("), s("options"))
        for ch in "BCD":
            options = F.replace(options, F.lit(f" {ch}) "), F.lit(f" ({ch}) "))
        text = F.concat(s("question"), F.lit("\nAnswer Choices: "), options)
    elif "aqua" in data_name:
        joined = F.concat(F.lit("("), F.array_join("options", "("))
        spaced = strip(F.replace(F.replace(joined, F.lit("("), F.lit(" (")), F.lit(")"), F.lit(") ")))
        text = F.concat(s("question"), F.lit("\nAnswer Choices: "), spaced)
    elif data_name == "gaokao_math_qa":
        pairs = F.transform(F.map_entries("options"), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"]))
        text = F.concat(s("question"), F.lit("\n选项: "), F.array_join(pairs, " "))
    else:
        text = _c(df.columns, "question", "problem", "Question", "input")
    if truth is not None:
        low = F.lower(truth)
        hint = F.when(low.isin("true", "false"), " (True or False)").when(low.isin("yes", "no"), " (Yes or No)").otherwise("")
        text = F.concat(text, F.coalesce(hint, F.lit("")))
    return strip(text)


def demo_source(data_name: str) -> str:
    for base, borrowers in P.DEMO_ALIASES.items():
        if data_name in borrowers:
            return base
    return data_name


def fill_template(template: str, field: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{" + field + "}"), value)


def demo_text(demos: DataFrame, data_name: str, prompt_type: str, shots: int) -> DataFrame:
    """One row with the first ``shots`` demos in one text; the frame has data_name, position, question, answer."""
    q, a, splitter = P.PROMPT_TEMPLATES[prompt_type]
    splitter = P.DEFAULT_SPLITTER if splitter is None else splitter
    if prompt_type == P.SINGLE_TURN_TEMPLATE:
        one = F.concat("question", F.lit("\n"), "answer")
    else:
        one = F.concat(fill_template(q, "input", F.col("question")), fill_template(a, "output", F.col("answer")))
    wanted = demos.where((F.col("data_name") == demo_source(data_name)) & (F.col("position") < shots))
    listed = F.sort_array(F.collect_list(F.struct("position", one.alias("t"))))
    return wanted.agg(F.array_join(F.transform(listed, lambda d: d["t"]), splitter).alias("demos"))


def few_shot_prompt(
    df: DataFrame, demos: DataFrame, data_name: str, prompt_type: str, shots: int,
    question: str = "question", adapt_few_shot: bool = False, gt_ans: str = "gt_ans", out: str = "full_prompt",
) -> DataFrame:
    """Prompt from a template with demos in front.

    With ``adapt_few_shot`` only rows whose answer is a choice letter get demos, five of
    them for the benchmarks that ask for it.
    """
    q, _, splitter = P.PROMPT_TEMPLATES[prompt_type]
    splitter = P.DEFAULT_SPLITTER if splitter is None else splitter
    count = 5 if adapt_few_shot and data_name in P.ADAPTIVE_SETS else shots
    ask = F.col(question)
    context = fill_template(q, "input", ask)
    front = demo_text(demos, data_name, prompt_type, count).scalar() if count else F.lit("")
    staged = df.withColumn("__demos", F.coalesce(front, F.lit("")))
    shown = F.col("__demos")
    if prompt_type == P.SINGLE_TURN_TEMPLATE:
        full = fill_template(q, "input", F.concat(shown, F.lit(splitter), ask))
    else:
        full = F.concat(shown, F.lit(splitter), context)
    bare = shown == ""
    if adapt_few_shot:
        bare = bare | ~F.col(gt_ans).isin("A", "B", "C", "D", "E")
    text = F.when(bare, context).otherwise(full)
    if prompt_type == "platypus_fs":
        text = fill_template(P.INSTRUCTION_WRAP, "instruction", text)
    if prompt_type in ("tora", "tool-integrated"):
        text = F.concat(F.lit(P.TOOL_INTRO), text)
    return staged.withColumn(out, F.trim(text)).drop("__demos")


def repeat_samples(df: DataFrame, n: int, out: str = "sample_idx") -> DataFrame:
    """Every prompt n times, numbered."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def group_id(df: DataFrame, keys: Sequence[str], out: str = "uid") -> DataFrame:
    """A reproducible id per prompt from its key columns."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*keys)), 256))

