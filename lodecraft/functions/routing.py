"""Rules that score and route queries, and the rewards of the older trajectory format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords, scores, limits and patterns that results depend on.
COMPLEX = ("证明", "推导", "分析", "评估", "比较", "设计", "优化", "实现", "调试", "定位", "explain", "prove", "derive", "analyze", "evaluate", "design", "optimize", "implement", "debug", "locate")
MULTI_STEP = ("首先", "然后", "接着", "最后", "步骤", "first", "then", "next", "finally", "step", "依次", "按照", "分步", "流程")
REASONING = ("为什么", "如何", "怎样", "推理", "逻辑", "why", "how", "reasoning", "logic", "deduce")
PROOF = ("证明", "证", "定理", "命题", "假设", "prove", "proof", "theorem", "proposition", "hypothesis", "矛盾", "反证", "归纳")
CODE = ("代码", "函数", "类", "算法", "实现", "code", "function", "class", "algorithm", "implement", "编程", "写一个", "Python", "Java", "JavaScript")
TYPES = (("proof", PROOF, 0.4), ("multi_step", MULTI_STEP, 0.35), ("code_gen", CODE, 0.4), ("reasoning", REASONING, 0.25), ("analysis", COMPLEX, 0.3))
CALCULATION, QA = ("calculation", 0.1), ("simple_qa", 0.0)
ARITHMETIC = r"[\d]+\s*[\+\-\*\/\^]\s*[\d]+"
TOKEN_THRESHOLD = 500
WORKFLOW_TYPES = ("proof", "multi_step")
PLAN_PATTERNS = (("proof", "证明.*|证.*定理.*|推导.*"), ("calculation", r"计算.*|\d+[\+\-\*\/]\d+.*|求.*"), ("analysis", "分析.*|评估.*|比较.*"), ("code", "实现.*|写.*代码.*|设计.*函数.*"), ("explain", "解释.*|说明.*|为什么.*"))
PLAN_GOALS = {"proof": "证明", "calculation": "计算", "analysis": "分析", "code": "实现", "explain": "解释", "general": "解决"}
TOOLS = (("calculator", ("计算", "算", "+", "-", "*", "/", "求和")), ("logic_checker", ("验证", "检查", "逻辑", "证明")), ("data_analyzer", ("分析", "统计", "数据")))
CRITIC_ERROR = "失败|错误|异常|fail|error|exception|wrong|无法|不能|不支持|不存在|无效"
CRITIC_WARNING = "可能|也许|不确定|需要验证|might|maybe|uncertain|verify"
CRITIC_SUCCESS = "完成|成功|正确|通过|complete|success|correct|pass|证明|推导|结论"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """The text holds one of the words, case counting: searched for byte by byte, which is faster than a pattern of alternatives."""
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def estimate_tokens(text: Column) -> Column:
    """1.5 a Chinese character, 1 an English word, 0.5 for the rest of the length, truncated."""
    chinese = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")))
    english = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    rest = F.length(text) - chinese - english
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.floor(chinese * 1.5 + english + rest * 0.5)).cast("long")


def task_type(text: Column) -> Column:
    """The first type whose keywords the query holds; then arithmetic; else a simple question."""
    out = None
    for name, words, _ in TYPES:
        out = F.when(any_of(text, words), name) if out is None else out.when(any_of(text, words), name)
    return out.when(text.rlike(ARITHMETIC), CALCULATION[0]).otherwise(QA[0])


def complexity(text: Column, tokens: Column, kind: Column, rounds: Column, threshold: int = TOKEN_THRESHOLD) -> Column:
    """A score up to 1 from length, type, rounds of history and complex keywords; rounded to 9 places."""
    length = F.when(tokens > threshold * 2, 0.3).when(tokens > threshold, 0.2).when(tokens > threshold / 2, 0.1).otherwise(0.0)
    by_type = F.lit(QA[1])
    for name, score in [(n, s) for n, _, s in TYPES] + [CALCULATION]:
        by_type = F.when(kind == name, score).otherwise(by_type)
    history = F.when(rounds >= 5, 0.15).when(rounds >= 3, 0.1).when(rounds >= 1, 0.05).otherwise(0.0)
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in COMPLEX), F.lit(0))
    return F.round(F.least(length + by_type + history + F.least(hits * 0.05, F.lit(0.15)), F.lit(1.0)), 9)


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "complex").when(score >= 0.4, "medium").otherwise("simple")


def confidence(score: Column, tokens: Column) -> Column:
    """Low near the levels' borders, high for short and long inputs."""
    near = (F.round(F.abs(score - 0.4), 9) < 0.1) | (F.round(F.abs(score - 0.7), 9) < 0.1)
    return F.when(near, 0.7).when((tokens < 50) | (tokens > 1000), 0.95).otherwise(0.85)


def route(kind: Column, level_: Column, sure: Column, tokens: Column, forced: Column | None = None, threshold: int = TOKEN_THRESHOLD) -> Column:
    """``direct_turbo``, ``direct_max`` or ``workflow``; a known forced route wins."""
    easy = (level_ == "simple") & (sure > 0.85) & kind.isin("simple_qa", "calculation")
    out = F.when(easy, "direct_turbo").when(kind.isin(*WORKFLOW_TYPES), "workflow").when(level_ == "complex", "direct_max").when((level_ == "medium") & (tokens >= threshold), "direct_max").otherwise("direct_turbo")
    if forced is None:
        return out
    wanted = F.lower(forced)
    return F.when(wanted == "turbo", "direct_turbo").when(wanted == "max", "direct_max").when(wanted == "workflow", "workflow").otherwise(out)


def plan_type(text: Column) -> Column:
    out = None
    for name, pattern in PLAN_PATTERNS:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def select_tool(text: Column) -> Column:
    out = None
    for name, words in TOOLS:
        hit = any_of(F.lower(text), words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("calculator")


def fibonacci_sum(n: Column, most: int = 80) -> Column:
    """The sum of the first n Fibonacci numbers; null beyond ``most``, where it would not fit."""
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("s"))
    fold = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(most))), start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b"), (s["s"] + s["b"]).alias("s")))
    return F.when(n <= 0, F.lit(0).cast("long")).when(n <= most, fold["s"])


def critic_one(result: Column) -> Column:
    """The verdict on one tool result."""
    low = F.lower(result)
    return F.when(low.rlike(CRITIC_ERROR), "rejected").when(low.rlike(CRITIC_WARNING), "needs_improvement").otherwise("approved")


def critic_all(results: Column, subtasks: Column) -> Column:
    """The verdict on all of them: an error, then missing results, then success beside failure."""
    error = F.exists(results, lambda r: F.lower(r).rlike(CRITIC_ERROR))
    complete = (F.size(results) >= subtasks) & F.forall(results, lambda r: r.isNotNull() & (r != ""))
    return F.when(error, "rejected").when(~complete, "needs_improvement").otherwise("approved")


# --- rewards of the older format


def accuracy(success: Column, query: Column, answer: Column, weight: float = 1.0) -> Column:
    base = F.when(success, 1.0).otherwise(-0.5)
    digits = F.when(F.contains(query, F.lit("计算")) & answer.rlike(r"\d+"), 0.2).otherwise(0.0)
    proof = F.when(F.contains(query, F.lit("证明")) & answer.rlike("证明|因为|所以|因此"), 0.2).otherwise(0.0)
    size = F.when(F.length(answer).between(50, 500), 0.1).otherwise(0.0)
    return (base + digits + proof + size) * weight


def efficiency(steps: Column, tools: Column, weight: float = 0.5) -> Column:
    by_steps = F.when(steps == 0, 0.0).when(steps <= 5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (steps - 5) / 10))
    by_tools = F.when(tools <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (tools - 2) / 5))
    return (by_steps + by_tools) / 2 * weight


def safety(errors: Column, states: Column, weight: float = 0.3) -> Column:
    back = F.when(F.size(F.array_distinct(states)) < F.size(states), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - errors * 0.2 - back) * weight


def consistency(query: Column, answer: Column, weight: float = 0.2) -> Column:
    words = F.regexp_extract_all(query, F.lit(r"(?U)\w+"), F.lit(0))
    met = F.size(F.filter(words, lambda w: F.contains(F.lower(answer), F.lower(w))))
    return F.when(F.size(words) > 0, met / F.size(words)).otherwise(0.0) * weight
