"""Token counts that follow edits.

A document's text is cut into pre-tokens, which are encoded one by one, so its token count is a sum over pre-tokens. Runs of LEAF
pre-tokens are the leaves of a segment tree that holds the characters and tokens below each node. An edit walks down the tree
to the leaves it touches, re-encodes them with the context that can move a boundary, up to the first old leaf start that is a boundary again, and
updates the sums on the way up. The rest of the text is neither cut nor encoded again.

Null texts count as empty. An edit replaces the characters [start, stop) of the text as the earlier edits left it; a
range beyond the text is clipped, null parts count as nothing. Repeated rows are counted one by one.
"""

import base64
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import map_texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern of the vocabulary that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
#: A match depends on the text up to two characters behind its end.
CONTEXT = 2
_MEMO = 300_000
_split = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), {}


def token_counter(ranks: bytes):
    """A function from pre-tokens to their token counts; it remembers up to _MEMO pre-tokens."""
    encoding, memo = _encoder(ranks)

    def count(pieces: list[str]) -> np.ndarray:
        if len(memo) > _MEMO:
            memo.clear()
        out = list(map(memo.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    out[i] = memo[p] = len(encoding.encode_ordinary(p))
        return np.array(out, np.int64)

    return count


class SegmentTree:
    """Sums of characters and tokens over leaves, in a heap: node i has the children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = max(1, len(chars))
        self.base = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + len(chars), 0], self.sums[self.base : self.base + len(chars), 1] = chars, tokens
        level = self.base
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's start; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if offset >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        leaf = node - self.base
        if leaf >= self.leaves:
            leaf = self.leaves - 1
            start = self.chars - int(self.sums[self.base + leaf, 0])
        return leaf, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.base + leaf
        step = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += step
            node //= 2


def _leaves(pieces: list[str], tokens: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    if not pieces:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    starts = np.arange(0, len(pieces), size)
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)


def build(text: str, count) -> SegmentTree:
    pieces = _split.findall(text)
    return SegmentTree(*_leaves(pieces, count(pieces)))


def edit(tree: SegmentTree, text: str, start: int, stop: int, new: str, count) -> tuple[SegmentTree, str, int]:
    """The tree and text after one edit, and how many characters were cut and encoded again."""
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    after = text[:start] + new + text[stop:]
    shift = len(after) - len(text)
    first, at = tree.leaf_at(max(0, start - CONTEXT - 1))
    last, end = tree.leaf_at(stop)
    end += int(tree.sums[tree.base + last, 0])  # old offset behind the last leaf touched
    pieces, pos = [], at
    while True:
        m = _split.match(after, pos)
        if m is None:
            last = tree.leaves - 1
            break
        while last + 1 < tree.leaves and end + shift < pos:
            last += 1
            end += int(tree.sums[tree.base + last, 0])
        # An old leaf start, clear of the edit, that is a boundary again: all that follows is as it was.
        if pos == end + shift and end >= stop and last + 1 < tree.leaves:
            break
        pieces.append(m.group())
        pos = m.end()
    tokens = count(pieces)
    slots = last - first + 1
    if len(pieces) > 4 * LEAF * slots or first + slots > tree.leaves:  # leaves have grown too long: lay them out anew
        chars, sums = _leaves(pieces, tokens)
        old = tree.sums[tree.base : tree.base + tree.leaves]
        rest = old[last + 1 :]
        return SegmentTree(np.concatenate([old[:first, 0], chars, rest[:, 0]]), np.concatenate([old[:first, 1], sums, rest[:, 1]])), after, pos - at
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    cuts = np.linspace(0, len(pieces), slots + 1).astype(int)
    for k in range(slots):
        tree.set(first + k, int(chars[cuts[k] : cuts[k + 1]].sum()), int(tokens[cuts[k] : cuts[k + 1]].sum()))
    return tree, after, pos - at


def edited_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts before and after each document's `edits`, an array of (start, stop, text).

    (doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_chars_encoded); the last counts the characters
    encoded again for the edits. One pass over the rows, no shuffle. The vocabulary file is read by the driver; its size is fixed.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(part, texts):
        count = token_counter(ranks)
        names = ("n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_encoded")
        out = {"doc_id": part.column(0), **{n: [] for n in names}}
        for t, changes in zip(texts, part.column(1).to_pylist(), strict=True):
            s = t.decode("utf-8", "replace")
            tree = build(s, count)
            n, tokens, again = len(s), tree.tokens, 0
            for e in changes or ():
                a = (e or {}).get("start") or 0
                b = (e or {}).get("stop")
                tree, s, k = edit(tree, s, a, a if b is None else b, (e or {}).get("text") or "", count)
                again += k
            for name, x in zip(names, (n, tokens, len(changes or ()), len(s), tree.tokens, again), strict=True):
                out[name].append(x)
        yield out

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(edits).cast("array<struct<start:int,stop:int,text:string>>").alias("_edits"), F.col(text).alias("text"))
    return map_texts(rows, run, "doc_id bigint, n_chars bigint, n_tokens bigint, n_edits bigint, n_chars_after bigint, n_tokens_after bigint, n_chars_encoded bigint", ["_key", "_edits"])
