"""Edit-aware token counts.

A text is cut into segments at places that no pre-token crosses whatever stands around them: before a
single space that follows a non-space and precedes a letter or digit.  A tokenizer that works pre-token
by pre-token encodes each segment on its own, so a document's count is the sum of its segments' counts.
The counts are the leaves of a binary tree whose inner nodes hold sums.  An edit re-encodes only the
segments that it touches, and as many neighbours as it takes until the region again ends at safe
places; then the sums on the way to the root are updated.

``counted`` can keep a document's tree (``keep_tree``): the ends and counts of its segments.  ``recounted``
takes kept trees and edits, encodes only what the edits touch, and returns the edited text with its tree,
ready for the next edits.

Edge cases: a null or empty text has no token and an empty tree; edits are applied in order of their
start and are clipped to the text; of edits that overlap, end before they start or have a null place, none
of the document's is applied, and ``error`` says so (null otherwise); an edit's null text deletes; a null
list has no edits; an edit may delete everything or fill an empty text; a kept tree that does not fit its
text is built anew; a text without any safe place is one segment; very long texts are cut every
``SEGMENT`` characters or soon after; repeated rows are counted each; empty tables give empty results;
other columns are kept untouched, and added columns replace columns of the same names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import unused

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 512
_SAFE = re.compile(r"(?<=\S)(?= [^\W_])")

Edit = tuple[int, int, str]  # start, end (characters), replacement


@cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file; read once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str = VOCABULARY) -> Callable[[str], int]:
    encode = encoding(path).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def cuts(text: str, segment: int = SEGMENT) -> list[int]:
    """Ends of the segments of a text; the last is its length."""
    out, at = [], segment
    while at < len(text) and (m := _SAFE.search(text, at)):
        out.append(m.start())
        at = m.start() + segment
    return [*out, len(text)] if text else []


class SegmentTree:
    """Token counts of one document's segments, with subtree sums."""

    def __init__(self, text: str, count: Callable[[str], int], segment: int = SEGMENT, kept: tuple[list[int], list[int]] | None = None):
        """``kept`` holds the ends and counts of the segments, where they are known: nothing is encoded then."""
        self.count, self.segment = count, segment
        self.parts: list[str] = []
        ends, counts = kept or ([], [])
        fits = len(ends) == len(counts) and (ends[-1:] == [len(text)] if text else not ends)
        begin = 0
        for end in ends if kept and fits else cuts(text, segment):
            self.parts.append(text[begin:end])
            begin = end
        self.encoded = 0 if kept and fits else len(text)  # characters encoded so far
        self._grow(list(counts) if kept and fits else [count(p) for p in self.parts])

    def ends(self) -> list[int]:
        return list(accumulate(map(len, self.parts)))

    def _grow(self, leaves: list[int]) -> None:
        """Sums over leaves: node i has children 2i and 2i + 1, leaf j is node size + j."""
        self.size = max(1, len(leaves))
        self.sums = [0] * self.size + (leaves or [0])
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def leaves(self) -> list[int]:
        return self.sums[self.size : self.size + len(self.parts)]

    def _set(self, leaf: int, value: int) -> None:
        i = self.size + leaf
        change = value - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def apply(self, edits: list[Edit]) -> None:
        """Replace each [start, end) of the present text; one pass over the segments."""
        if not edits:
            return
        starts, at = [], 0
        for p in self.parts:
            starts.append(at)
            at += len(p)
        edits = sorted((max(0, min(a, at)), max(0, min(b, at)), s) for a, b, s in edits)
        if any(a > b for a, b, _ in edits) or any(x[1] > y[0] for x, y in zip(edits, edits[1:], strict=False)):
            raise ValueError("edits overlap or end before they start")
        leaves = self.leaves()
        parts, counts, changed = [], [], {}
        i, e, n = 0, 0, len(self.parts)
        reshaped = False
        while i < n or e < len(edits):
            if e == len(edits) or (i < n and starts[i] + len(self.parts[i]) < edits[e][0]):
                parts.append(self.parts[i])
                counts.append(leaves[i])
                i += 1
                continue
            # a region: the segments that the next edits touch, until it ends at a safe place
            first, region, low = i, self.parts[i] if i < n else "", starts[i] if i < n else at
            if i < n and edits[e][0] == low and parts:  # an edit at the very beginning also changes what stands before
                first -= 1
                region, low = parts.pop() + region, low - len(self.parts[first])
                counts.pop()
            high = low + len(region)
            i = max(i + 1, first + 1) if i < n else i
            out, done = [], low
            while True:
                while e < len(edits) and edits[e][0] <= high:
                    a, b, s = edits[e]
                    while b > high or (a == high and i < n):
                        region += self.parts[i]
                        high += len(self.parts[i])
                        i += 1
                    out += [region[done - low : a - low], s]
                    done = b
                    e += 1
                tail = region[done - low :]
                new = "".join(out) + tail
                left = parts[-1][-1:] if parts else ""
                right = self.parts[i][:2] if i < n else ""
                if i < n and not (new and _SAFE.match(new[-1:] + right, 1)):
                    region += self.parts[i]  # boundary context: what follows no longer starts at a safe place
                    high += len(self.parts[i])
                    i += 1
                elif parts and new and not _SAFE.match(left + new[:2], 1):
                    first -= 1  # what stands before, as it is by now, joins the region
                    out.insert(0, parts.pop())
                    counts.pop()
                    changed.pop(len(parts), None)
                else:
                    break
            begin = 0
            fresh = []
            for end in cuts(new, self.segment):
                fresh.append(new[begin:end])
                begin = end
            self.encoded += len(new)
            if len(fresh) == i - first:
                changed.update({len(parts) + j: self.count(p) for j, p in enumerate(fresh)})
                counts += [0] * len(fresh)
            else:
                reshaped = True
                counts += [self.count(p) for p in fresh]
            parts += fresh
        self.parts = parts
        if reshaped:
            for k, v in changed.items():
                counts[k] = v
            self._grow(counts)
        else:
            for k, v in changed.items():
                self._set(k, v)


#: Edits by rule: pattern -> replacement. Personal data in running text is masked.
MASKS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "[mail]"),
    (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"), "[address]"),
    (re.compile(r"(?<!\d)\d{9,19}(?!\d)"), "[number]"),
)
_MAYBE = re.compile(r"@|\d\.\d|\d{9}")


def mask_edits(text: str) -> list[Edit]:
    """The edits that mask e-mail addresses, network addresses and long numbers; the first of overlapping ones holds."""
    if not _MAYBE.search(text):
        return []
    found = sorted((m.start(), m.end(), s) for pattern, s in MASKS for m in pattern.finditer(text))
    out: list[Edit] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


TREE = "tree struct<ends:array<int>,counts:array<int>>"
SCHEMA = f"n_tokens long, n_tokens_edited long, n_segments long, n_edits long, n_chars_reencoded long, error string, {TREE}"
_TREE = pa.struct([("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_NUMBERS = ("n_tokens", "n_tokens_edited", "n_segments", "n_edits", "n_chars_reencoded")
_FIELDS = [*((n, pa.int64()) for n in _NUMBERS), ("error", pa.string()), ("tree", _TREE)]


def _checked(changes: list[dict | None] | None) -> tuple[list[Edit], str | None]:
    """The edits of a row, or what is wrong with them."""
    edits = []
    for c in changes or []:
        if c is None or c["start"] is None or c["end"] is None:
            return [], "an edit has no place"
        edits.append((max(0, c["start"]), max(0, c["end"]), c["text"] or ""))
    edits.sort()
    if any(a > b for a, b, _ in edits):
        return [], "an edit ends before it starts"
    if any(x[1] > y[0] for x, y in zip(edits, edits[1:], strict=False)):
        return [], "edits overlap"
    return edits, None


def _row(tree: SegmentTree, edits: list[Edit], error: str | None, keep: bool) -> dict:
    before, read = tree.total, tree.encoded
    tree.apply(edits)
    numbers = (before, tree.total, len(tree.parts), len(edits), tree.encoded - read)
    return {**dict(zip(_NUMBERS, numbers, strict=True)), "error": error, "tree": {"ends": tree.ends(), "counts": tree.leaves()} if keep else None}


def counted(docs: DataFrame, text: str = "text", edits: str | None = None, vocabulary: str = VOCABULARY, segment: int = SEGMENT, keep_tree: bool = False) -> DataFrame:
    """``docs`` with token counts before and after edits; one narrow pass.

    ``edits`` names a column ``array<struct<start:int,end:int,text:string>>``; without it the edits
    are those of ``mask_edits``.  ``n_chars_reencoded`` is what the edits made the tokenizer read
    again.  ``tree`` is the tree after the edits (null unless ``keep_tree``), that of the edited text.
    """

    def rows(texts: pa.Array, changes: pa.Array | None) -> pa.Array:
        count, out = counter(vocabulary), []
        given = changes.to_pylist() if changes is not None else [None] * len(texts)
        for value, change in zip(texts.to_pylist(), given, strict=True):
            value = value or ""
            todo, error = (mask_edits(value), None) if changes is None else _checked(change)
            out.append(_row(SegmentTree(value, count, segment), todo, error, keep_tree))
        return pa.array(out, pa.struct(_FIELDS))

    names = [f[0] for f in _FIELDS]
    (mark,) = unused(docs, "counted")
    if edits is None:

        @F.arrow_udf(SCHEMA)
        def run(texts: pa.Array) -> pa.Array:
            return rows(texts, None)

        found = docs.withColumn(mark, run(F.col(text)))
    else:

        @F.arrow_udf(SCHEMA)
        def run_given(texts: pa.Array, changes: pa.Array) -> pa.Array:
            return rows(texts, changes)

        found = docs.withColumn(mark, run_given(F.col(text), F.col(edits)))
    return found.select(*[c for c in docs.columns if c not in names], *[F.col(f"{mark}.{n}").alias(n) for n in names])


def recounted(docs: DataFrame, edits: str, text: str = "text", tree: str = "tree", vocabulary: str = VOCABULARY, segment: int = SEGMENT) -> DataFrame:
    """``docs`` with the edits applied to the text and to its kept tree; one narrow pass.

    The columns are those of ``counted``; text and tree are replaced by the edited ones.
    """

    @F.arrow_udf(f"{SCHEMA}, text string")
    def run(texts: pa.Array, kept: pa.Array, changes: pa.Array) -> pa.Array:
        count, out = counter(vocabulary), []
        for value, known, change in zip(texts.to_pylist(), kept.to_pylist(), changes.to_pylist(), strict=True):
            todo, error = _checked(change)
            held = SegmentTree(value or "", count, segment, (known["ends"], known["counts"]) if known and known["ends"] is not None and known["counts"] is not None else None)
            row = _row(held, todo, error, True)
            out.append({**row, "text": held.text if value is not None or todo else None})
        return pa.array(out, pa.struct([*_FIELDS, ("text", pa.string())]))

    names = [f[0] for f in _FIELDS if f[0] != "tree"]
    (mark,) = unused(docs, "counted")
    found = docs.withColumn(mark, run(F.col(text), F.col(tree), F.col(edits))).withColumn(text, F.col(f"{mark}.text")).withColumn(tree, F.col(f"{mark}.tree"))
    return found.select(*[c for c in docs.columns if c not in names], *[F.col(f"{mark}.{n}").alias(n) for n in names])
