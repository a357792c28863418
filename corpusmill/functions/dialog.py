"""Dialogue acts, reply discipline, and what a turn follows. (FLT21-22, WIN1, WIN9, CHT1)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import quality as Q

# Fixed values.
GREETINGS = ("hi", "hello", "hey", "good morning", "good evening", "good afternoon", "how are you", "what's up", "whats up", "how is it going", "nice to meet")
CODE_WORDS = ("python", "javascript", "java", "code", "function", "class", "def", "import", "script", "program", "debug", "compile", "algorithm", "plainformat")
RETURN_CONTEXT = ("value", "statement", "type", "keyword")
VERBS = ("write", "implement", "create", "develop", "explain", "solve", "convert", "generate", "design", "debug", "describe", "summarize", "translate", "classify", "list")
QUESTION_WORDS = ("who", "whom", "whose", "what", "when", "where", "why", "how", "which", "whether", "is", "are", "was", "were", "do", "does", "did", "can", "could", "would", "should", "will", "have", "has", "had")
REASONING = ("how many", "calculate", "prove", "logic", "step")
CODE_MARKS = ("```", "#include", "plainformat", "def ", "function ", "return ", "import ", "class ", "for (", "while (", "if (", "=>")
AI_DISCLOSURES = ("as an ai", "as a language model", "as an ai language model")
ROBOTIC = ("بالتأكيد", "يمكنني مساعدتك", "عزيزي المستخدم", "as an ai", "as a language model", "i'm just an ai", "i am an ai")
CONNECTORS = {
    "causal": ("because", "therefore", "so", "thus", "hence", "as a result", "since"),
    "contrast": ("however", "but", "although", "though", "nevertheless", "yet", "instead"),
    "sequence": ("first", "second", "third", "next", "then", "finally", "last"),
}
ROLE_ALIASES = (
    dict.fromkeys(("system", "developer"), "system")
    | dict.fromkeys(("user", "human", "question", "instruction", "prompt", "problem", "query", "input"), "user")
    | dict.fromkeys(("assistant", "gpt", "ai", "answer", "response", "output", "completion"), "assistant")
)


def low_trimmed(t: Column) -> Column:
    """ASCII lower case without blanks at the ends."""
    return F.translate(F.regexp_replace(t, r"\A[ \t\n\r]+|[ \t\n\r]+\z", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def _starts(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike(rf"\A{_any(words)}(?![A-Za-z0-9_])")


def _has(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike(rf"(?<![A-Za-z0-9_]){_any(words)}(?![A-Za-z0-9_])")


def dialog_act(t: Column) -> Column:
    """greeting, coding, instruction, question, reasoning or chitchat, the first that fits; unknown for an empty text. (FLT21)"""
    low = low_trimmed(t)
    coding = Q.holds_any(low, ("```", "#include")) | _has(low, CODE_WORDS) | (_has(low, ("return",)) & _has(low, RETURN_CONTEXT))
    asks = F.regexp_replace(t, r"""[ \t\n\r"']+\z""", "").endswith("?") | _starts(low, QUESTION_WORDS)
    return (
        F.when(t == "", "unknown")
        .when(_starts(low, GREETINGS), "greeting")
        .when(coding, "coding")
        .when(_starts(low, VERBS), "instruction")
        .when(asks, "question")
        .when(Q.holds_any(low, REASONING), "reasoning")
        .otherwise("chitchat")
    )


def reply_reason(prompt: Column, reply: Column) -> Column:
    """Why a reply is not disciplined, or ``ok``. (FLT22)"""
    asked, low = low_trimmed(prompt), low_trimmed(reply)
    options = F.regexp_count(asked, F.lit(r"(?<![A-Za-z0-9_])[a-d][.):]"))
    return (
        F.when(F.octet_length(low) < 2, "empty")
        .when(Q.holds_any(low, AI_DISCLOSURES), "ai-disclosure")
        .when((options >= 2) & ~low.rlike(r"(?s)\A[a-d][.):]."), "bad-mc-format")
        .when((dialog_act(prompt) == "coding") & ~Q.holds_any(low, CODE_MARKS), "no-code")
        .otherwise("ok")
    )


def robotic(t: Column) -> Column:
    """(EVL2)"""
    return Q.holds_any(F.lower(t), ROBOTIC)


def with_context(turns: DataFrame) -> DataFrame:
    """Each turn with the last user text up to it, and the text just before it. (WIN1, JN10)"""
    order = W.partitionBy("conv_id").orderBy("turn")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.select(
        "*",
        F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(upto), F.lit("")).alias("last_user"),
        F.lag("text", 1, "").over(order).alias("prev_text"),
    )


def rendered(turns: DataFrame, prompt: bool = False) -> DataFrame:
    """(conv_id, rendered): marker text of each conversation, with ``prompt`` ready for a reply. Roles other than system and assistant speak as the user. (CHT1)"""
    role = F.when(F.col("role").isin("system", "assistant"), F.col("role")).otherwise("user")
    one = F.concat(F.lit("<|"), role, F.lit("|>"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), "")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("<s>"), told, F.lit("<|assistant|>" if prompt else "")).alias("rendered"))


def trimmed(turns: DataFrame, most: int) -> DataFrame:
    """The turns of (conv_id, turn, role, text) that a chat keeps: the first, and the last 2 * ``most``, from further back if those would begin with a reply. (WIN9)"""
    whole = W.partitionBy("conv_id").orderBy("turn")
    n = F.count(F.lit(1)).over(W.partitionBy("conv_id"))
    at = turns.withColumn("_at", F.row_number().over(whole) - 1).withColumn("_n", n)
    start = F.col("_n") - 2 * most
    # the last turn at or before the start that is no reply, but never the first
    back = F.max(F.when((F.col("_at") <= start) & (F.col("_at") >= 1) & (F.col("role") != "assistant"), F.col("_at"))).over(W.partitionBy("conv_id"))
    keep = (F.col("_n") <= 1 + 2 * most) | (F.col("_at") == 0) | (F.col("_at") >= F.coalesce(back, F.lit(1)))
    return at.withColumn("_keep", keep).filter("_keep").drop("_at", "_n", "_keep")


def role_of(name: Column) -> Column:
    """The standard role of an alias; null for roles that are set aside. (SRC13)"""
    out = F
    for alias, role in ROLE_ALIASES.items():
        out = out.when(F.lower(name) == alias, role)
    return out.otherwise(None)
