"""Fixed values that results depend on."""

# --- fixed values: prompts -------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a helpful assistant. "
    "To answer the user’s question, you first think about the reasoning process and then "
    "provide the user with the answer. The reasoning process and answer are enclosed within "
    "<think> and <answer> tags, respectively, i.e., <think> reasoning process here </think> "
    "<answer> answer here </answer>."
)

SYSTEM_PROMPT_BOXED = (
    "You are a helpful assistant. "
    "To answer the user’s question, you first think about the reasoning process and then "
    "provide the user with the answer. The reasoning process and answer are enclosed within "
    "<think> and <answer> tags, respectively, i.e., <think> reasoning process here </think> "
    "<answer> \\boxed{answer here} </answer>."
)

# The training loader uses a plain apostrophe and a leading blank.
SYSTEM_PROMPT_TRAINING = (
    " You are a helpful assistant. To answer the user's question, you first think about the "
    "reasoning process and then provide the user with the answer. The reasoning process and "
    "answer are enclosed within <think> and <answer> tags, respectively, i.e., <think> reasoning "
    "process here </think> <answer> answer here </answer>."
)

INSTRUCTION_HEAD = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.  \n\n"
    "                #### Instruction:\n"
    "                "
)
INSTRUCTION_MIDDLE = "\n                \n                #### Response:\n                "

SYSTEM_MARKER = "<|im_start|>system"

# --- fixed values: curation ------------------------------------------------------------------
DENIED_CONTENT = ("KodCode", "codeio", "OpenCoder", "OpenCoderStage2")
CODE_SOURCES = ("codeio", "OpenCoder", "OpenCoderStage2", "prime")
UNTEMPLATED_DATASETS = ("math_10k", "gsm8k", "svamp", "mawps")
FORMAT_PATTERN = r"^<think>.*?</think>\s*<answer>.*?\\boxed\{.*?\}.*?</answer>$"
FORMAT_SCORE = 0.25
HEAD_ROWS = 1000
BOXED_PATTERN = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"

# --- fixed values: benchmarks ----------------------------------------------------------------
QUESTION_FIELDS = ("question", "instruction", "problem", "input", "original_text", "prompt")
ANSWER_FIELDS = ("answer", "target", "label", "solution", "output", "ans")

BENCHMARK_ALIASES = {
    "aime": "aime2025",
    "aime25": "aime2025",
    "math500test": "math500",
    "amc": "amc23",
}

EXPECTED_ROWS = {
    "math500": 500,
    "aime2025": 30,
    "amc23": 40,
    "aqua": 254,
    "gsm8k": 1319,
    "mawps": 238,
    "svamp": 1000,
}

# protocol -> benchmark -> (max_input_tokens, max_new_tokens, max_model_len); "" is the default
TOKEN_LIMITS = {
    "paper": {
        "math500": (4096, 4096, 8192),
        "aime2025": (4096, 8192, 12288),
        "amc23": (4096, 8192, 12288),
        "": (4096, 4096, 8192),
    },
    "opd": {
        "math500": (1024, 4096, 5120),
        "aime2025": (2048, 8192, 10240),
        "amc23": (2048, 8192, 10240),
        "": (1024, 4096, 5120),
    },
}

NUMBER_GRADED = ("gsm8k", "svamp", "mawps", "multiarith", "addsub", "singleeq")
CHOICE_GRADED = ("aqua",)
CHOICE_LETTERS = ("A", "B", "C", "D", "E")

# --- fixed values: tokens and weights --------------------------------------------------------
IGNORED_LABEL = -100
ENTROPY_EPS = 1e-12
ADA_EPS = 1e-12
BROWN_EPS = 1e-8

# --- fixed values: answer patterns ------------------------------------------------------------
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
BOXED_LETTER_PATTERN = r"\\boxed\{\s*([A-E])\s*\}"
STATED_LETTER_PATTERN = r"(?:final\s+)?answer\s*(?:is|:)?\s*\(?([A-E])\)?\b"
CHOICE_PATTERN = r"\(([A-E])\)\s*([^(]+?)(?=\s*\([A-E]\)|\s*$)"
