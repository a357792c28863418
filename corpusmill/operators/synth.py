"""Seeded dialogue generation and transliteration. (SYN1-3, WIN3, NRM13-14)

Every choice is a hash of the row's id and the seed, so any partition can be made again alone. The small
tables below are this library's own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.rng import Rng

DOMAINS = {
    "travel": ("book a train", "find a quiet hostel", "plan a day by the sea"),
    "cooking": ("bake flat bread", "cook lentils", "store fresh herbs"),
    "study": ("learn new words", "take better notes", "read a long paper"),
}
OPENINGS = ("Could you help me {}?", "I would like to {}.", "How do I {}?", "What is the best way to {}?")
REPLIES = ("First, write down what you need to {}. Then start with the smallest step.", "To {}, begin early because it takes time.", "Many people {} this way: prepare, try once, and adjust.")
CLOSERS = ("Thanks, that helps.", "Good, I will try it.", "")


def _pick(options: tuple[str, ...], seed: int, salt: str) -> Column:
    at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(options)))
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))


def generate(spark: SparkSession, n: int, seed: int = 0, per_template: int | None = None) -> DataFrame:
    """(conv_id, domain, template_id, messages): up to n dialogues; with ``per_template`` each template is used that often at most."""
    pairs = tuple(f"{d}\t{task}" for d, tasks in DOMAINS.items() for task in tasks)
    rows = spark.range(n).withColumn("pair", _pick(pairs, seed, "domain")).withColumn("opening", _pick(OPENINGS, seed, "open")).withColumn("reply", _pick(REPLIES, seed, "reply")).withColumn("closer", _pick(CLOSERS, seed, "close"))
    task = F.split_part("pair", F.lit("\t"), F.lit(2))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    told = F.array_compact(F.array(say("user", F.replace("opening", F.lit("{}"), task)), say("assistant", F.replace("reply", F.lit("{}"), task)), F.when(F.col("closer") != "", say("user", F.col("closer")))))
    out = rows.select(F.col("id").alias("conv_id"), F.split_part("pair", F.lit("\t"), F.lit(1)).alias("domain"), F.xxhash64("pair", "opening", "reply").alias("template_id"), told.alias("messages"))
    if per_template is None:
        return out
    return out.withColumn("_use", F.row_number().over(W.partitionBy("template_id").orderBy("conv_id"))).filter(F.col("_use") <= per_template).drop("_use")


# The common way to write Moroccan Arabic in Latin letters: each letter with its usual spelling and one other.
LATIN = {
    "ا": ("a", "a"), "ب": ("b", "b"), "ت": ("t", "t"), "ث": ("t", "th"), "ج": ("j", "dj"), "ح": ("7", "h"), "خ": ("kh", "5"), "د": ("d", "d"), "ذ": ("d", "dh"), "ر": ("r", "r"),
    "ز": ("z", "z"), "س": ("s", "s"), "ش": ("ch", "sh"), "ص": ("s", "s"), "ض": ("d", "d"), "ط": ("t", "t"), "ظ": ("d", "d"), "ع": ("3", "3"), "غ": ("gh", "8"), "ف": ("f", "f"),
    "ق": ("9", "q"), "ك": ("k", "k"), "گ": ("g", "g"), "ل": ("l", "l"), "م": ("m", "m"), "ن": ("n", "n"), "ه": ("h", "h"), "و": ("w", "ou"), "ي": ("i", "y"), "ى": ("a", "a"),
    "ة": ("a", "a"), "ء": ("2", ""), "أ": ("a", "2a"), "إ": ("i", "2i"), "آ": ("a", "aa"), "،": (",", ","), "؟": ("?", "?"), "؛": (";", ";"),
}
#: Whole words with a spelling of their own.
WORDS = {"الله": "allah", "شكرا": "choukran", "واخا": "wakha", "دابا": "daba", "بزاف": "bzzaf", "مزيان": "mzyan", "ديال": "dyal", "كيفاش": "kifach"}
#: What a careless writer writes instead, and how often.
NOISE = (("ch", "sh", 0.25), ("ou", "o", 0.2), ("7", "h", 0.12), ("9", "q", 0.12), ("3", "a", 0.06))


def transliterated(text: str, rng: Rng, other: float = 0.2) -> str:
    """Arabic script in Latin letters: known words whole, the article as l, letters one by one, now and then by their other spelling. (NRM13)"""
    out = []
    for part in re.split(r"([ؠ-ۿ]+)", text):
        if part in WORDS:
            out.append(WORDS[part])
            continue
        if len(part) > 3 and part.startswith("ال"):
            out.append("l")
            part = part[2:]
        out += [LATIN[c][rng.uniform() < other] if c in LATIN else "" if "ً" <= c <= "ْ" else c for c in part]
    return "".join(out)


def noisy(latin: str, rng: Rng) -> str:
    """Spelling noise, each place by chance. (NRM14)"""
    table = {a: (b, p) for a, b, p in NOISE}
    return re.sub("|".join(table), lambda m: table[m[0]][0] if rng.uniform() < table[m[0]][1] else m[0], latin)


DARIJA = {
    "سوق": (("بشحال هاد الحاجة؟", "هادي بعشرين درهم."), ("واش كاين شي تخفيض؟", "واخا، نقص ليك شويه.")),
    "دار": (("فين كاين المفتاح؟", "المفتاح فوق الطبله."), ("شكون طيب العشا؟", "ميمتي طيبات الكسكس.")),
    "خدمة": (("كيفاش داز النهار؟", "داز مزيان الحمد لله."), ("امتى غادي تسالي؟", "غادي نسالي مع الستة.")),
}
FRENCH_SWITCH = ("D'accord.", "Merci bien.", "Pas de problème.")


def generate_darija(spark: SparkSession, n: int, seed: int = 0, latin: float = 0.4, french: float = 0.05) -> DataFrame:
    """(conv_id, domain, script, messages): n dialogues in either script, some ending in French. (SYN2)

    A dialogue is made from a generator of its own, seeded by its number, so any partition can be made again alone.
    """
    schema = "conv_id long, domain string, script string, messages array<struct<role:string,content:string>>"

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                rng = Rng(seed * 1_000_003 + i)
                domain = sorted(DARIJA)[rng.below(len(DARIJA))]
                pair = DARIJA[domain][rng.below(len(DARIJA[domain]))]
                script = "latin" if rng.uniform() < latin else "arabic"
                said = [noisy(transliterated(t, rng), rng) if script == "latin" else t for t in pair]
                if rng.uniform() < french:
                    said.append(FRENCH_SWITCH[rng.below(len(FRENCH_SWITCH))])
                rows.append({"conv_id": i, "domain": domain, "script": script, "messages": [{"role": ("user", "assistant")[k % 2], "content": t} for k, t in enumerate(said)]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return spark.range(n).mapInArrow(run, schema)
