"""SentencePiece BPE encoding and decoding by a table of prefixes.

Merges may join any two neighbours whose concatenation is a piece, best score
first.  Every prefix of a text has one encoding, and so one last token.  A token
t that ends at k is it exactly when t can follow the last token of the
prefix before t, that is, when the two, merged on their own, stay as they are.
An automaton over all pieces gives the candidates that end at each k; the
table is filled from left to right in one pass, and the ids are read backwards from its end.
Characters that are no piece stand alone and become their UTF-8 bytes' ids.

No piece spans from a non-space to a space mark, nor from a letter to a character that no
piece joins to letters, so a text is encoded word by word (space marks and letters, or space marks
and other characters).  The new words of a batch are taken in sorted order, and a word keeps the part of
the table that it shares with the one before.  Results are kept in a table of bounded size.

Nulls and empty texts have no ids and decode to the empty text.  Repeated rows are
answered one by one, extra columns ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from saleswell.llm.common import slices

MARK = "▁"
#: Bounds of the tables of words and of tested pairs in a task.
WORDS, PAIRS = 400_000, 500_000
BLOCK = 1 << 20
NONE = float("-inf")


class PieceModel:
    """Encoder and decoder of one BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: dict[int, bytes] = {}
        self.byte = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.NORMAL:
                self.id[p.piece], self.score[p.piece] = i, p.score
                self.text[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value], self.text[i] = i, bytes([value])
            elif p.type not in (kinds.CONTROL, kinds.UNKNOWN):
                raise ValueError(f"unsupported piece type: {p.piece}")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans a word boundary")
        self.longest = max(map(len, self.id))
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.word = re.compile(self._word_pattern())
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def _word_pattern(self) -> str:
        """Space marks with what follows: characters that pieces join to letters, directly or through others, or the rest."""
        beside: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:]):
                if MARK not in (a, b):
                    beside.setdefault(a, set()).add(b)
                    beside.setdefault(b, set()).add(a)
        known = {c for p in self.id for c in p} | set(map(chr, range(128)))
        todo = [c for c in known if c.isalpha()]
        joined = set(todo)
        while todo:
            fresh = beside.get(todo.pop(), set()) - joined
            joined |= fresh
            todo += fresh
        rest = "".join(map(re.escape, sorted(known - joined - {MARK})))
        return f"{MARK}*[^{MARK}{rest}]+|{MARK}*[{rest}]+|{MARK}+"

    def merged(self, text: str) -> list[str]:
        """Plain merging, for short strings: the best-scored pair, leftmost first, until none is left."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NONE:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether merging leaves left and right as two tokens; an empty left asks about right alone."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = known
        return known

    def tokens(self, words: Iterable[str]) -> Iterator[list[str]]:
        """The tokens of each word; neighbours that begin alike share the work."""
        before, last, empty = "", [""], {}
        find, pairs, follows = self.automaton.iter, self.pairs, self.follows
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            # Pieces by their end; at each end the longest first.
            ends: list[list[str]] = [[] for _ in range(len(word) - same)]
            for k, piece in find(word, max(0, same + 1 - self.longest)):
                if k >= same:
                    ends[k - same].append(piece)
            for k, candidates in enumerate(ends, same + 1):
                if not candidates or len(candidates[-1]) > 1:  # a character that is no piece stands alone
                    candidates.append(word[k - 1])
                for t in candidates:
                    left = last[k - len(t)]
                    if (left or k == len(t)) and ((known := pairs.get(left, empty).get(t)) or known is None and follows(left, t)):
                        last.append(t)
                        break
                else:
                    raise AssertionError(f"no last token at {k} of {word!r}")
            before, out, k = word, [], len(word)
            while k:
                out.append(last[k])
                k -= len(last[k])
            yield out[::-1]

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            i = self.id.get(t)
            if i is None:
                out.extend([self.byte[b] for b in t.encode("utf-8", "surrogatepass")])
            else:
                out.append(i)
        return out

    def learn(self, words: set[str]) -> None:
        """Enter new words: number of ids, ids in decimal, decoded bytes."""
        new = sorted(words - self.words.keys())
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = sorted(words)
        for word, tokens in zip(new, self.tokens(new)):
            ids = self.ids(tokens)
            self.words[word] = (len(ids), ",".join(map(str, ids)).encode(), self.decode_bytes(ids))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for block in blocks(text) for t in self.tokens(self.word.findall(block)) for i in self.ids(t)]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD each; the dummy prefix goes."""
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids and the digests of the ids and of the decoded text."""
        states = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            self.learn(set().union(*(words for _, words in held)))
            for k, words in held:
                found, state = [self.words[w] for w in words], states[k]
                first = state[0] == 0
                state[0] += sum([f[0] for f in found])
                state[1].update((b"" if first else b",") + b",".join([f[1] for f in found]))
                state[2].update(b"".join([f[2] for f in found])[1 if first else 0 :])
            held.clear()

        for k, text in enumerate(texts):
            for block in blocks(text):
                held.append((k, self.word.findall(block)))
                size += len(block)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [(n, ids.hexdigest(), decoded.hexdigest()) for n, ids, decoded in states]


_BREAK = re.compile(f"(?<!{MARK}){MARK}")


def blocks(text: str) -> Iterator[str]:
    """The normalised text (dummy prefix, marks for spaces) in parts of bounded size, cut at word boundaries."""
    if not text:
        return
    text = MARK + text.replace(" ", MARK)
    at = 0
    while len(text) - at > BLOCK and (m := _BREAK.search(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; ``path`` names the model file on every machine."""

    def run(batches):
        model = load(path)
        for batch in slices(batches, "text", 4 << 20):
            n, ids, decoded = zip(*model.digests([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (null text: none) for every row."""

    def run(batches):
        model = load(path)
        for batch in slices(batches, "text", 1 << 20):
            ids = pa.array([model.encode(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


