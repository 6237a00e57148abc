"""Personal data: fixed base patterns, and identifiers discovered from their contexts.

Base entities are the seeds of a bootstrap.  Candidates are words, and runs of digit groups
with the separators that seeds have (space, hyphen, dot, parentheses).  Lexical patterns of
an identifier are the two words before it, the two words after it, and its own shape (letters
and digits by class); an instance is the identifier's text.  Spark scores the graph of
patterns and instances in rounds: a pattern's confidence in a kind is the share of that kind
among the distinct identifier-like instances it introduces; an unlabelled instance's score in
a kind is that of its surest pattern with enough seeds (patterns of one place overlap, so
their confidences are not combined).  Instances that reach the acceptance score are seeds of
the next round, and spans of that kind in the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, join_skewed, materialize, short_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct seeds (by score) that a pattern needs, and the score that accepts an instance.
SUPPORT, ACCEPT = 4.0, 0.8
#: A shape tells nothing of the place, so it counts from this confidence on.
SURE_SHAPE = 0.9
#: An identifier-like word has so many digits at least, or an @.
DIGITS = 5
#: Digits and characters of a run of groups; a longer one is cut between groups.
MOST_DIGITS, MOST_CHARS = 19, 64
#: Characters from which on a pattern or instance is held as its hash.
LONG = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits: the run's start would have matched or failed first.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+|@")
_GROUPS = re.compile(r"(?<!\w)\+?\(?[0-9]++(?:(?:\.|[\x20()-]{1,3})[0-9]++)+(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")
_GROUP = re.compile(r"[0-9]+")
_LUHN = str.maketrans("0123456789", "0246813579")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    even = digits[-2::-2].translate(_LUHN)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, even))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base entities, by kind, then start."""
    out = [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return out


def _short(text: str) -> str:
    return text if len(text) <= LONG else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def before(text: str, start: int) -> str:
    """The two words before start, lower-cased, digits as #."""
    size = LONG
    while True:
        part = text[max(0, start - size) : start]
        words = part.split()
        if size >= start or len(words) > 2 or (len(words) == 2 and part[0].isspace()):
            return _short(re.sub("[0-9]", "#", " ".join(words[-2:]).lower())) or "^"
        size *= 2


def after(text: str, end: int) -> str:
    """The two words after end, lower-cased, digits as #; what is left of the identifier's own word counts as one."""
    size = LONG
    while True:
        part = text[end : end + size]
        words = part.split()
        if end + size >= len(text) or len(words) > 2 or (len(words) == 2 and part[-1].isspace()):
            return _short(re.sub("[0-9]", "#", " ".join(words[:2]).lower())) or "$"
        size *= 2


def shape(instance: str) -> str:
    """Digits as 9, runs of letters as a, the rest as it is."""
    return _short(_LETTERS.sub("a", re.sub("[0-9]", "9", instance)))


def patterns(text: str, start: int, end: int) -> list[str]:
    return [f"before {before(text, start)}", f"after {after(text, end)}", f"shape {shape(text[start:end])}"]


def identifier_words(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with DIGITS digits or an @ that touch no base span; outer punctuation is left out."""
    busy = sorted((s, e) for _, s, e in taken)
    last, k = 0, 0
    for run in _DIGIT_RUN.finditer(text):
        if run.start() < last:
            continue
        start, last = run.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while last < len(text) and not text[last].isspace():
            last += 1
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if k < len(busy) and busy[k][0] < last:
            continue
        left, right = start, last
        while left < right and not text[left].isalnum():
            left += 1
        while right > left and not text[right - 1].isalnum():
            right -= 1
        if len(_digits(text[left:right])) >= DIGITS or "@" in text[left:right]:
            yield left, right


def identifier_runs(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Digit groups over several words, DIGITS to MOST_DIGITS digits in all, that touch no base span.

    The plus sign or parenthesis before the first group belongs to the run.
    """
    parts, at = [], 0
    for s, e in sorted((s, e) for _, s, e in taken):
        if e > at:
            parts += (text[at : max(s, at)], "\n" * (e - max(s, at)))
            at = e
    text = "".join((*parts, text[at:]))
    for run in _GROUPS.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
        k = 0
        while k < len(groups):
            start, digits, last = run.start() if k == 0 else groups[k][0] - (text[groups[k][0] - 1] == "("), 0, k
            while last < len(groups) and groups[last][1] - start <= MOST_CHARS and digits + groups[last][1] - groups[last][0] <= MOST_DIGITS:
                digits += groups[last][1] - groups[last][0]
                last += 1
            if last > k:
                end = groups[last - 1][1]
                if text[start] == "(" and ")" not in text[start:end]:
                    start += 1
                if digits >= DIGITS and " " in text[start:end]:
                    yield start, end
            k = max(last, k + 1)


FOUND = "doc_id long, tie long, base array<struct<kind:int,start:long,end:long>>, seen array<struct<kind:int,start:long,end:long,patterns:array<string>,instance:string>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: base spans, and all identifiers (kind -1: unlabelled) with their contexts."""
    short_batches(df.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    seen = pa.struct([*span, ("patterns", pa.list_(pa.string())), ("instance", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, other = [], []
            for text in batch["text"].to_pylist():
                own = base_spans(text)
                base.append(own)
                other.append([(k, s, e, patterns(text, s, e), _short(text[s:e].lower())) for k, s, e in (*own, *((-1, s, e) for s, e in (*identifier_words(text, own), *identifier_runs(text, own))))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array([[dict(zip(span.names, x, strict=True)) for x in row] for row in base], pa.list_(span)), pa.array([[dict(zip(seen.names, x, strict=True)) for x in row] for row in other], pa.list_(seen))], names=["doc_id", "tie", "base", "seen"])

    return id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text")).mapInArrow(run, FOUND)


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """Unlabelled instances that the graph accepts: instance, kind, score.

    seen: kind, pattern, instance, one row per occurrence.  Edges are distinct pairs, so a
    copied document adds nothing.  A pattern may have a third of all edges, so joins on it are
    split (join_skewed).  Ties between kinds go to the one listed first.  Without rows, or
    without a pattern of enough seeds, nothing is accepted.
    """
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    total = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    every = edges.count()
    scores = None
    for _ in range(rounds):
        labelled = edges.where("kind >= 0").select("pattern", F.col("kind").alias("of"), F.lit(1.0).alias("part"))
        if scores is not None:
            labelled = labelled.unionByName(edges.where("kind < 0").join(scores.where(F.col("score") >= accept), "instance").select("pattern", "of", F.col("score").alias("part")))
        mass = labelled.groupBy("pattern", "of").agg(F.sum("part").alias("mass"))
        sure = mass.where(F.col("mass") >= support).join(total, "pattern").select("pattern", "of", (F.col("mass") / (F.col("n") + 1)).alias("sure"), "n")
        sure = sure.where(~F.col("pattern").startswith("shape ") | (F.col("sure") >= SURE_SHAPE))
        best = materialize(sure.groupBy("pattern").agg(F.max(F.struct("sure", F.negative("of").alias("of"))).alias("best"), F.first("n").alias("n")).where(F.col("best.sure") >= accept / 2), "pii-sure")
        reached = join_skewed(edges.where("kind < 0"), best, "pattern", every).groupBy("instance").agg(F.max("best").alias("best"))
        scores = materialize(reached.select("instance", F.negative("best.of").alias("of"), F.round("best.sure", 9).alias("score")), "pii-scores")
    return scores.select("instance", F.col("of").alias("kind"), "score").where(F.col("score") >= accept)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every text: doc_id, base and spans (arrays of kind number, start, end).

    Offsets are code points, end exclusive.  spans holds the base spans and the discovered
    ones, by kind, then start; a discovered span inside a longer one is left out.  Null and empty texts have none; repeated rows get equal rows;
    an empty table gives none.
    """
    found = materialize(scan(df, id_col, text_col), "pii-found")
    seen = found.select("doc_id", "tie", F.explode("seen").alias("x")).select("doc_id", "tie", "x.*")
    taken = bootstrap(seen.select("kind", F.explode("patterns").alias("pattern"), "instance"))
    more = seen.where("kind < 0").drop("kind").join(taken, "instance").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    more = more.withColumn("more", F.filter("more", lambda x: ~F.exists("more", lambda y: inside(x, y))))
    both = found.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", "tie", "base").join(more.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "tie", "more"), ["key", "tie"], "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))).alias("spans"))


def _one_if(kind: int):
    return lambda x: F.when(x == kind, 1)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from find()'s rows."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _one_if(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))
