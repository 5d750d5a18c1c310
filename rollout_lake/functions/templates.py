"""Prompt templates of the benchmark toolkit (fixed values): question, answer, separator."""

STEP_BY_STEP = "Please reason step by step, and put your final answer within \\boxed{}."

PROMPT_TEMPLATES: dict[str, tuple[str, str, str | None]] = {
    "direct": ("Question: {input}\nAnswer: ", "{output}", "\n\n"),
    "cot": ("Question: {input}\nAnswer: ", "{output}", "\n\n\n"),
    "pal": ("Question: {input}\n\n", "{output}", "\n---\n"),
    "tool-integrated": ("Question: {input}\n\nSolution:\n", "{output}", "\n---\n"),
    "self-instruct": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "tora": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "wizard_zs": ("### Instruction:\n{input}\n\n### Response: Let's think step by step.", "{output}", "\n\n\n"),
    "platypus_fs": ("### Instruction:\n{input}\n\n### Response:\n", "{output}", "\n\n\n"),
    "deepseek-math": ("User: {input}\n" + STEP_BY_STEP + "\n\nAssistant:", "{output}", "\n\n\n"),
    "kpmath": (
        'User: Please reason step by step and put your final answer at the end with "The answer is: ".\n\n{input}\n\nAssistant:',
        "{output}", None,
    ),
    "jiuzhang": ("## Question\n{input}\n\n## Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_tora": ("## Question\n{input}\n\n## Code Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_nl": ("## Question\n{input}\n\n## Natural Language Solution\n", "{output}", "\n\n\n"),
    "mmiqc": (
        'Please solve the following problem and put your answer at the end with "The answer is: ".\n\n{input}\n\n',
        "{output}", "\n\n\n",
    ),
    "abel": ("Question:\n{input}\nAnswer:\nLet's think step by step.\n", "{output}", "\n\n"),
    "shepherd": ("{input}\n", "{output}", "\n\n\n"),
    "qwen-boxed": (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{input}\n" + STEP_BY_STEP
        + "<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n",
    ),
    "qwen25-math-cot": (
        "<|im_start|>system\n" + STEP_BY_STEP + "<|im_end|>\n<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n",
        "{output}", "\n\n",
    ),
    "mathstral": ("{input}\n" + STEP_BY_STEP, "{output}", "\n\n"),
    "internlm-math-fs": ("Question:{input}\nAnswer:", "{output}", "\n"),
    "internlm-math-chat": ("<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n"),
    "mistral": ("[INST] {input}[/INST]", "{output}", "\n\n"),
    "numina": ("### Problem: {input}\n### Solution:", " {output}", "\n\n"),
}
DEFAULT_SPLITTER = "\n\n"
SINGLE_TURN_TEMPLATE = "qwen25-math-cot"
INSTRUCTION_WRAP = (
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:\n"
)
TOOL_INTRO = (
    "Integrate step-by-step reasoning and Python code to solve math problems using the following guidelines:\n\n"
    "- Analyze the question and write functions to solve the problem; the function should not take any arguments.\n"
    "- Present the final result in LaTeX using a `\x08oxed{}` without any units.\n"
    "- Utilize the `pi` symbol and `Rational`` from Sympy for $\\pi$ and fractions, and simplify all fractions and square "
    "roots without converting them to decimal values.\n\nHere are some examples you may refer to:\n\n---\n\n"
)

DEMO_ALIASES = {
    "gsm8k": ("gsm_hard", "svamp", "tabmwp", "asdiv", "mawps"),
    "math": ("math_oai", "hungarian_exam", "math-oai", "aime24", "amc23"),
    "mmlu_stem": ("sat_math",),
    "gaokao": ("gaokao2024_I", "gaokao2024_II", "gaokao_math_qa", "gaokao2024_mix", "cn_middle_school"),
}
"""Which demos a benchmark borrows."""

ADAPTIVE_SETS = DEMO_ALIASES["gaokao"]
"""Benchmarks that always get five demos when few-shot adapts to the answer."""

STEM_SUBJECTS = (
    "abstract_algebra", "astronomy", "college_biology", "college_chemistry", "college_computer_science",
    "college_mathematics", "college_physics", "computer_security", "conceptual_physics", "electrical_engineering",
    "elementary_mathematics", "high_school_biology", "high_school_chemistry", "high_school_computer_science",
    "high_school_mathematics", "high_school_physics", "high_school_statistics", "machine_learning",
)
