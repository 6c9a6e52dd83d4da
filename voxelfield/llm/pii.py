"""Personal data by bootstrapped contextual extraction.

Strict patterns find sure entities (the base). Around every base entity, and
around everything else that looks like one, the words on both sides give
lexical patterns. Spark scores the graph of patterns and instances in rounds:
a pattern is as good as the share of its instances that are good, an instance
as good as its patterns make it, base instances being sure. Patterns of high
confidence, seen with several different base instances, then mark the unseen
identifiers in their slots.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import filled, map_slices

KINDS = ("email", "ip", "card", "phone")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does, which spares long runs a second look.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
MARKED = re.compile(r"[0-9@]\S*")
NUMBER = re.compile(r"[0-9().+/ -]+")
# What an unseen identifier of a kind looks like: strict enough to be one, looser than the base.
SHAPES = {
    "email": re.compile(r"[^\s@]{1,64}@[^\s@]{2,255}"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9][0-9 .-]{10,30}[0-9]"),
    "phone": re.compile(r"\+?[0-9(][0-9 ()./-]{5,24}[0-9]"),
}
SHAPE_DIGITS = {"card": (12, 19), "phone": (7, 15)}

ROUNDS = 3
# A pattern marks unseen identifiers from this confidence and this many different base instances on.
CONFIDENCE = 0.8
SUPPORT = 3
# A word of a context: a run of letters, or a number.
WORD = re.compile(r"[^\W\d_]+|\d+")

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the name is the run of name characters before an @ with a host."""
    done = 0
    for host in EMAIL_HOST.finditer(text):
        start = host.start()
        while start > done and text[start - 1] in EMAIL_NAME:
            start -= 1
        if start < host.start():
            done = host.end()
            yield start, done


def base_spans(text: str) -> list[Span]:
    """Spans of the strict patterns, by kind and start; a match that fails its check is dropped."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m.group())) <= 15:
                spans.append((3, *m.span()))
    return spans


def marked_words(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, numbers next to each other as one; outer marks left out."""
    found: list[list[int]] = []
    number = False  # whether the last one found is a number so far
    for m in MARKED.finditer(text):
        start, end = m.span()
        floor = found[-1][1] if found else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        before, number = number, NUMBER.fullmatch(text, start, end) is not None
        if found and before and number and start == found[-1][1] + 1 and text[start - 1] == " ":
            found[-1][1] = end
        else:
            found.append([start, end])
    out = []
    for start, end in found:
        while start < end and text[start] in "\"'<[{|,;:!?":
            start += 1
        while end > start and text[end - 1] in "\"'>]}|,;:!?.":
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def unseen_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans with the shape of an identifier that overlap no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out, at = [], 0
    for start, end in marked_words(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if any(a < end and start < b for a, b in taken[at:at + 8]):
            continue
        word = text[start:end]
        digits = len(DIGITS.sub("", word))
        for no, kind in enumerate(KINDS):
            low, high = SHAPE_DIGITS.get(kind, (0, 1 << 30))
            if low <= digits <= high and SHAPES[kind].fullmatch(word):
                out.append((no, start, end))
    return out


class Contexts:
    """Lexical patterns of the slots of a text, whose words are found once.

    A slot has the two words before it, and the words on both sides, however
    far they are; numbers read as 0. Patterns without a letter are none.
    """

    def __init__(self, text: str) -> None:
        self.text, self.words = text, [m.span() for m in WORD.finditer(text)]

    def _word(self, start: int, end: int) -> str:
        word = self.text[start:end]
        return word.lower() if word[0].isalpha() else "0"

    def of(self, start: int, end: int) -> list[str]:
        # The first word that ends behind the slot's start may reach into the slot, as the last one may from its end.
        first = bisect.bisect_right(self.words, start, key=lambda w: w[1])
        left = [self._word(*w) for w in self.words[max(0, first - 2) : first]]
        if first < len(self.words) and self.words[first][0] < start:
            left = [*left[-1:], self._word(self.words[first][0], start)]
        last = bisect.bisect_right(self.words, end, key=lambda w: w[1])
        right = [self._word(max(a, end), b) for a, b in self.words[last : last + 1]]
        found = {" ".join([*left, "_"]): left, " ".join([*left[-1:], "_", *right]): [*left[-1:], *right]}
        return [pattern for pattern, used in found.items() if any(w != "0" for w in used)]


def instance(text: str, kind: int) -> str:
    return text.lower() if kind == 0 else DIGITS.sub("", text)


def occurrences(documents: DataFrame) -> DataFrame:
    """(row, doc_id, base, seen): base spans, and all slots with instance, patterns and whether they are base."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    slot = pa.struct([
        ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("sure", pa.bool_()),
        ("instance", pa.string()), ("patterns", pa.list_(pa.string())),
    ])

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        base_rows, slot_rows = [], []
        for text in filled(part.column("text")).to_pylist():
            base = base_spans(text)
            unseen = unseen_spans(text, base)
            around = Contexts(text) if base or unseen else None
            base_rows.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            slot_rows.append([
                {"kind": k, "start": a, "end": b, "sure": sure, "instance": instance(text[a:b], k), "patterns": around.of(a, b)}
                for sure, spans in ((True, base), (False, unseen)) for k, a, b in spans
            ])
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), pa.array(base_rows, pa.list_(span)), pa.array(slot_rows, pa.list_(slot))],
            names=["row", "doc_id", "base", "slots"],
        )

    spans = "array<struct<kind:int,start:long,end:long>>"
    slots = "array<struct<kind:int,start:long,end:long,sure:boolean,instance:string,patterns:array<string>>>"
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    return map_slices(rows.select("row", "doc_id", "text"), handle, f"row long, doc_id long, base {spans}, slots {slots}")


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, confidence, support) from distinct edges (kind, pattern, instance, sure).

    A pattern's confidence is the sum of its instances' scores over one more
    than their number. An unseen instance's score is the chance that one of its
    patterns is right, if their confidences were independent.
    """
    scores = edges.groupBy("kind", "instance").agg(F.max("sure").alias("sure"))
    scores = scores.select("kind", "instance", "sure", F.col("sure").cast("double").alias("score"))
    for last in [False] * (rounds - 1) + [True]:
        patterns = (
            edges.select("kind", "pattern", "instance").join(scores, ["kind", "instance"])
            .groupBy("kind", "pattern")
            .agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum(F.col("sure").cast("long")).alias("support"))
        )
        patterns = stored(patterns, "patterns")
        if last:
            return patterns
        doubt = F.log(F.greatest(1 - F.when(F.col("support") >= SUPPORT, F.col("confidence")).otherwise(0.0), F.lit(1e-9)))
        scores = (
            edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance")
            .agg(F.max("sure").alias("sure"), (1 - F.exp(F.sum(doubt))).alias("score"))
            .withColumn("score", F.when(F.col("sure"), 1.0).otherwise(F.col("score")))
        )
    raise ValueError("rounds must be positive")


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans, each (kind, start, end) in code points, sorted.

    One row per row of ``documents`` (doc_id, text; further columns are
    ignored). NULL reads as empty: no spans. Every base span stays; what the
    patterns add overlaps none of them. Equal rows get equal spans. Empty
    input, empty result.
    """
    rows = stored(occurrences(documents), "occurrences")
    slots = rows.select("row", F.explode("slots").alias("s")).select("row", "s.*").withColumn("pattern", F.explode("patterns"))
    edges = slots.groupBy("kind", "pattern", "instance").agg(F.max("sure").alias("sure"))
    # Only patterns that some base instance has can be learned.
    known = edges.where("sure").select("kind", "pattern").distinct()
    edges = stored(edges.join(known, ["kind", "pattern"], "left_semi"), "edges")
    good = pattern_scores(edges).where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
    hits = slots.where("not sure").join(good, ["kind", "pattern"])
    # A slot that patterns of several kinds claim goes to the most confident, the first kind among equals.
    best = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    joined = rows.select("row", "doc_id", "base").join(added, "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def written(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per kind over all spans, the digest of the base spans, and all spans as text."""
    count = lambda no: F.expr(f"cast(size(filter(spans, s -> s.kind = {no})) as long)")
    return found.select(
        "doc_id", *[count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)],
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )
