"""BPE encoding and decoding by tree concatenation.

A text is cut into the stretches that the tokenizer's own splitting rule yields. Short
stretches are encoded by the model as they are. A stretch longer than ``leaf_chars``, which
nothing splits, is halved until its parts are short; the parts are encoded in parallel, and the
halves are then joined pairwise, all joins of a level side by side: around each join a growing
window is encoded again until its first token agrees with a token of the left half and its last
sound token with one of the right half. Every neighbouring pair of tokens in the result then stands next to each other in
some valid encoding, which for BPE makes the whole a valid, and so the only, encoding.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Generator, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._common import pieces, released

LEAF_CHARS = 16
MEMO_WORDS = 200_000
#: Strings in a batch of the library, which encodes them in parallel.
LANES = 8
#: Stretches in a string at least: below this, threads cost more than they save.
LANE_STRETCHES = 4096


def inert(char: str) -> bool:
    """Whether normalisation treats this character by itself: it is neither a mark nor a Hangul
    letter part, which join with others, nor unknown to this Python's tables."""
    c = ord(char)
    return unicodedata.category(char) not in ("Mn", "Mc", "Me", "Cn") and not (0x1100 <= c < 0x1200 or 0xA960 <= c < 0xA980 or 0xD7B0 <= c < 0xD800)


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class TreeBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    It takes files with an NFC / white-space / lower-case normaliser, a splitting pattern
    followed by byte letters, and a BPE model with a word-end suffix. Special tokens in the
    raw text become their own ids, as in the library.
    """

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, memo_words: int = MEMO_WORDS) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("this vocabulary's normaliser or splitter isn't known")
        self.end = spec["model"]["end_of_word_suffix"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.tokens: list[str] = [""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in spec["model"]["vocab"].items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = [len(t) - len(self.end) * t.endswith(self.end) for t in self.tokens]
        # the same model without normaliser or splitter, for stretches already in byte letters
        bare = dict(spec, normalizer=None, pre_tokenizer={"type": "WhitespaceSplit"}, added_tokens=[], post_processor=None)
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.letters = dict(enumerate(_byte_letters()))
        self.bytes = {ord(letter): byte for byte, letter in self.letters.items()}
        self.inert: set[str] = set()
        self.library = Tokenizer.from_str(json.dumps(spec))  # for the characters that only its tables know
        self.leaf = leaf_chars
        self.limit = memo_words
        self.memo: dict[str, bytes] = {}

    def _model_many(self, stretches: Sequence[str]) -> list[list[int]]:
        """The model's ids of each stretch.

        Stretches are strung together, so that they cost few calls, and cut apart at the tokens
        that end a word. The library encodes the strings of a batch in parallel, so many leaves or
        windows are dealt to LANES strings.
        """
        size = max(LANE_STRETCHES, -(-len(stretches) // LANES))
        parts = [stretches[k : k + size] for k in range(0, len(stretches), size)]
        out: list[list[int]] = []
        for part, found in zip(parts, self.model.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            rows: list[list[int]] = []
            row: list[int] = []
            for i in found.ids:
                row.append(i)
                if self.tokens[i].endswith(self.end):
                    rows.append(row)
                    row = []
            if len(rows) != len(part):  # a letter outside the vocabulary gave no token
                rows = [self.model.encode(x, add_special_tokens=False).ids for x in part]
            out += rows
        return out

    def _ends(self, ids: Sequence[int], start: int) -> list[int]:
        at = []
        for i in ids:
            start += self.size[i]
            at.append(start)
        return at

    def _join(self, s: str, left: list[int], right: list[int], a: int, m: int, b: int) -> Generator[str, list[int], list[int]]:
        """The encoding of ``s[a:b]`` from those of ``s[a:m]`` and ``s[m:b]``; it yields the windows
        that it needs encoded, so that many joins can go on side by side.

        Where ``b`` is inside the word, the last token of a half may carry a false word end;
        tokens that touch such an edge never count as agreeing.
        """
        l_end = self._ends(left, a)
        l_start = [a, *l_end[:-1]]
        r_end = self._ends(right, m)
        r_start = [m, *r_end[:-1]]
        reach = 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            u, v = l_start[i], r_end[j - 1]
            window = yield s[u:v]
            w_end = self._ends(window, u)
            w_start = [u, *w_end[:-1]]
            sound = len(window) if v == b else len(window) - 1  # the last may carry a false end
            head = {(x, y): k for k, (x, y) in enumerate(zip(l_start[i:], l_end[i:], strict=True), i) if y < m}
            x = next((k for k in range(sound) if (q := head.get((w_start[k], w_end[k]))) is not None and left[q] == window[k]), None)
            if i == 0 and u == a:
                x_at, left_part = 0, []
            elif x is not None:
                x_at, left_part = x, left[: head[w_start[x], w_end[x]]]
            else:
                x_at, left_part = None, []
            tail = {(p, q): k for k, (p, q) in enumerate(zip(r_start[:j], r_end[:j], strict=True))}
            last = None
            if v == b:
                last, right_part = len(window) - 1, []
            else:
                for k in range(sound - 1, -1, -1):
                    q = tail.get((w_start[k], w_end[k]))
                    if q is not None and right[q] == window[k]:
                        last, right_part = k, right[q + 1 :]
                        break
            if x_at is not None and last is not None and x_at <= last:
                return left_part + window[x_at : last + 1] + right_part
            reach *= 2

    def _tree(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of long stretches: all leaves at once, then the joins level by level from the bottom."""
        cuts, leaves = [], []
        for s in words:
            n = 1 << max(0, (len(s) - 1) // self.leaf).bit_length()
            at = sorted({len(s) * k // n for k in range(n + 1)})
            cuts.append(at)
            leaves += [s[p:q] for p, q in zip(at, at[1:], strict=False)]
        ids = iter(self._model_many(leaves))
        rows = [[next(ids) for _ in at[1:]] for at in cuts]
        while any(len(r) > 1 for r in rows):
            joins = [(w, k) for w, r in enumerate(rows) for k in range(0, len(r) - 1, 2)]
            done = self._side_by_side([self._join(words[w], rows[w][k], rows[w][k + 1], *cuts[w][k : k + 3]) for w, k in joins])
            merged: list[list[list[int]]] = [[] for _ in words]
            for (w, _), row in zip(joins, done, strict=True):
                merged[w].append(row)
            for w, r in enumerate(rows):
                if len(r) > 1:
                    rows[w] = merged[w] + r[len(r) - len(r) % 2 :]
                    cuts[w] = [*cuts[w][::2], *([cuts[w][-1]] if len(r) % 2 else [])]
        return [r[0] for r in rows]

    def _side_by_side(self, joins: list[Generator[str, list[int], list[int]]]) -> list[list[int]]:
        """What all joins give; the windows that they ask for at a time are encoded together."""
        out: list[list[int]] = [[] for _ in joins]
        asked = {k: next(join) for k, join in enumerate(joins)}
        while asked:
            more = {}
            for k, window in zip(asked, self._model_many(list(asked.values())), strict=True):
                try:
                    more[k] = joins[k].send(window)
                except StopIteration as end:
                    out[k] = end.value
            asked = more
        return out

    def _learn(self, words: Sequence[str]) -> None:
        if len(self.memo) + len(words) > self.limit:
            self.memo.clear()
        written = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        short = [k for k, x in enumerate(written) if len(x) <= self.leaf]
        long = [k for k, x in enumerate(written) if len(x) > self.leaf]
        for at, ids in ((short, self._model_many([written[k] for k in short])), (long, self._tree([written[k] for k in long]))):
            for k, row in zip(at, ids, strict=True):
                self.memo[words[k]] = np.array(row, dtype="<u4").tobytes()

    def normalise(self, text: str) -> str:
        """NFC and lower case; white space needs no change, as no stretch holds any."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def stretches(self, text: str) -> list[str]:
        """The stretches that the tokenizer's splitting rule yields, normalised.

        The library's tables are of other Unicode versions than Python's. Characters that stand by
        themselves and are known to Python are treated alike by both; texts with any other are
        normalised and split by the library itself.
        """
        if text.isascii():
            return self.split.findall(text.lower())
        new = set(text) - self.inert
        self.inert.update(filter(inert, new))
        if new <= self.inert:
            return self.split.findall(self.normalise(text))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, map(ord, piece))).decode() for piece, _ in found]

    def encode_packed(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        parts: list[list] = []
        for text in texts:
            row: list = []
            for k, x in enumerate(self.at_special.split(text or "") if self.at_special else [text or ""]):
                row.append(np.array([self.special[x]], dtype="<u4").tobytes() if k % 2 else self.stretches(x))
            parts.append(row)
        new = {w for row in parts for x in row if isinstance(x, list) for w in x if w not in self.memo}
        if new:
            self._learn(list(new))
            if lost := {w for row in parts for x in row if isinstance(x, list) for w in x if w not in self.memo}:
                self.limit, limit = 1 << 62, self.limit  # the memo was emptied: learn what else these texts need
                self._learn(list(lost))
                self.limit = limit
        get = self.memo.__getitem__
        return [b"".join(x if isinstance(x, bytes) else b"".join(map(get, x)) for x in row) for row in parts]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens' own strings with a space between, as the library gives without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, leaf_chars: int = LEAF_CHARS, memo_words: int = MEMO_WORDS) -> TreeBpe:
    return TreeBpe(path, leaf_chars, memo_words)


def bpe_encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",), full: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Result: ``id_cols``, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` string, and if
    ``full`` also ``ids`` array<int> and ``decoded`` string. Null and empty texts have no ids.
    Repeated rows and null ids come back as they are; an empty table gives an empty result;
    other columns are not read. ``vocabulary`` is a file that every executor has.
    """
    ids = list(id_cols)
    source = docs.select(*ids, text_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ids)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in pieces(batches, 256):
            packed = bpe.encode_packed(batch.column(len(ids)).to_pylist())
            rows = [np.frombuffer(x, dtype="<u4").tolist() for x in packed] if full else None
            texts = [bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in packed]
            columns = [batch.column(i) for i in range(len(ids))]
            columns += [
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
            ]
            names = [*ids, "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array(rows, pa.list_(pa.int32())), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(released(run), schema)
