"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie over their symbols. A depth-first walk carries, for each
trie node, the last token of the encoding of the prefix that the node spells. Of all tokens that
are suffixes of the prefix (an automaton over all tokens lists them) exactly one may follow the
encoding of what stands before it, namely the one that makes, with its left neighbour, a pair that
the merges would leave alone. So each node costs a few lookups, a prefix that many words share is encoded once, and a word's tokens are read
backwards from its leaf. The trie is walked in its sorted form: in sorted order the nodes that two
neighbouring words share are their common prefix, and the stack holds the states of one path.

Text is cut as the tokenizer file says. All steps of the file act inside runs of non-blanks. Runs
beyond ASCII and common Latin letters go through the file's own normalizer and splitter, so that
rare characters follow the library; their words take the same walk.

Null text counts as empty: no tokens. Empty tables give empty results. Rows repeat as they come.
Texts of any length are handled whole, one slice of rows at a time; the word cache is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACES, map_arrow, slices

END = "</w>"
#: Code-point shift that marks a word's last symbol.
FINAL = 0x20000
#: Stands for the last token of the empty prefix.
START = (1 << 20) - 1
#: Distinct words a worker remembers before it forgets the rare ones, and pairs before it starts anew.
CACHE_WORDS = 300_000
CACHE_PAIRS = 400_000
#: Letters that, with ASCII, the fast path takes: all are letters, and lower-case one to one.
PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-įĹ-ňŊ-ž"


def byte_symbols() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class TrieBpe:
    """Encoder and decoder for one tokenizer file of kind BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a tokenizer file of the kind this encoder is for")
        vocab = model["vocab"]
        self.special = special
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        #: Tokens as runs of symbols, one character each.
        self.tokens = {self._symbols(t): i for t, i in vocab.items() if t not in special}
        self.runs = {i: t for t, i in self.tokens.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.rank[self._symbols(left), self._symbols(right)] = r
        self.bytes = byte_symbols()
        (cut,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Over plain characters the classes of the file's pattern are these ranges.
        self.cut = re.compile(cut.replace(r"\p{L}", PLAIN_LETTERS).replace(r"\p{N}", "0-9"))
        self.plain = re.compile(f"[\t-\r -~{PLAIN_LETTERS}]*")
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.state_of: dict[str, int] = {"": 0}
        self.spelled, self.moves, self.ends = [""], [{}], [()]
        self.reset()

    @staticmethod
    def _symbols(token: str) -> str:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def reset(self) -> None:
        """Forget all words but those met more than once since the last time."""
        known = getattr(self, "known", {})
        kept = [(w, i) for w, i in known.items() if self.met[i] > 1][: CACHE_WORDS // 2]
        ids = [self.flat[self.starts[i] : self.starts[i + 1]] for _, i in kept]
        self.known: dict[str, int] = {w: n for n, (w, _) in enumerate(kept)}
        self.starts: list[int] = [0, *np.cumsum([len(x) for x in ids]).tolist()] if ids else [0]
        self.used = self.starts[-1]
        self.flat = np.zeros(max(1 << 16, 2 * self.used), dtype=np.int32)
        if ids:
            self.flat[: self.used] = np.concatenate(ids)
        self.met = np.zeros(len(kept), dtype=np.int64)

    # -- words of a text ----------------------------------------------------------------------

    def words(self, text: str | None) -> list[str]:
        """Keys of the text's words: a plain word is its own key, others are spelled in byte symbols
        after a NUL, and a special token is its name."""
        if not text:
            return []
        if "<|" not in text and self.plain.fullmatch(text):
            return self.cut.findall(text.lower())
        out: list[str] = []
        for chunk in _SPACES.split(text):
            for part in self.special_re.split(chunk) if self.special_re and "<|" in chunk else (chunk,):
                if part in self.special:
                    out.append(part)
                elif self.plain.fullmatch(part):
                    out += self.cut.findall(part.lower())
                elif part:
                    out += ["\0" + w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def _run(self, key: str) -> str:
        word = key[1:] if key[0] == "\0" else key if key.isascii() else "".join(map(self.bytes.__getitem__, key.encode()))
        return word[:-1] + chr(ord(word[-1]) + FINAL)

    # -- which tokens may stand side by side --------------------------------------------------

    def _merged(self, run: str) -> list[str]:
        """What the merges make of a few symbols: always the earliest merge, leftmost first."""
        parts = list(run)
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    joined.append(a + b)
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair alone; left START: whether they make the token at all."""
        a, b = [] if left == START else [self.runs[left]], self.runs[right]
        known = self._merged("".join(a) + b) == [*a, b]
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = known
        return known

    def _move(self, state: int, symbol: str) -> int:
        """The automaton's next state: the longest run that ends here and begins some token."""
        run = self.spelled[state] + symbol
        while run and run not in self.prefixes:
            run = run[1:]
        to = self.state_of.get(run)
        if to is None:
            to = self.state_of[run] = len(self.spelled)
            self.spelled.append(run)
            self.moves.append({})
            self.ends.append(tuple((self.tokens[run[i:]], len(run) - i) for i in range(len(run)) if run[i:] in self.tokens))
        self.moves[state][symbol] = to
        return to

    # -- the walk -----------------------------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encode distinct words (runs of symbols) in one depth-first walk over their trie."""
        out: dict[str, list[int]] = {}
        # By depth on the path: automaton state, last token of the prefix's encoding, its length.
        states, last, size = [0], [START], [0]
        path = ""
        moves, ends, pairs = self.moves, self.ends, self.pairs
        for word in sorted(words):
            depth = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                depth += 1
            del states[depth + 1 :], last[depth + 1 :], size[depth + 1 :]
            state = states[-1]
            for d in range(depth + 1, len(word) + 1):
                symbol = word[d - 1]
                to = moves[state].get(symbol)
                state = self._move(state, symbol) if to is None else to
                for token, k in ends[state]:
                    before = last[d - k]
                    ok = pairs.get(before << 20 | token)
                    if self._may_follow(before, token) if ok is None else ok:
                        states.append(state)
                        last.append(token)
                        size.append(k)
                        break
                else:
                    raise ValueError("a symbol is missing from the vocabulary")
            ids, d = [], len(word)
            while d > 0:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            out[word] = ids
            path = word
        return out

    # -- batches ------------------------------------------------------------------------------

    def _learn(self, keys: set[str]) -> None:
        runs = {k: self._run(k) for k in keys if k not in self.special}
        found = self.encode_words(set(runs.values()))
        flat: list[int] = []
        for k in keys:
            flat += found[runs[k]] if k in runs else [self.special[k]]
            self.known[k] = len(self.starts) - 1
            self.starts.append(self.used + len(flat))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.met = np.concatenate([self.met, np.zeros(len(keys), np.int64)])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and the texts' offsets into them."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.reset()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        rows = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(ws) for ws in split], out=rows[1:])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(rows[-1]))
        self.met += np.bincount(at, minlength=len(self.met))
        starts = np.asarray(self.starts, dtype=np.int64)
        lengths = starts[at + 1] - starts[at]
        ends = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(lengths, out=ends[1:])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], lengths)]
        return ids, ends[rows]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The file names no decoder, so decoded text is the tokens joined by one blank."""
        name, flat, cuts = self.names.__getitem__, ids.tolist(), offsets.tolist()
        return [" ".join(map(name, flat[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


_LOADED: dict[str, TrieBpe] = {}


def _encoder(path: str) -> TrieBpe:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row of docs.

    One pass in Python workers over whole texts, no shuffle. tokenizer_path must be readable on
    the executors (it comes with an installed package). Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = bpe.encode_batch(part.column(1).to_pylist())
                arrays = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(bpe.decode_batch(ids, offsets), type=pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "ids", "decoded"])

    return src.transform(map_arrow, run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """Per row: number of tokens, and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
