"""Byte-pair encoding and decoding by a tokenization automaton (Berglund et al., 2024).

The automaton reads tokens. It starts as one state with an arc for every byte, and accepts all
sequences. Each merge of u and v is built in by a gadget, in the order of the merges:

- the state behind u loses its arc v, as the two do not stand side by side any more;
- every state with an arc u gets an arc uv as well;
- behind uv is a state of its own, a copy of the one behind v as it was before the gadget.

What is left at the end accepts just the tokenizer's own sequences, one for each text. Copies are
not written out: a state keeps the arcs it lost itself, with the number of the gadget, and
refers to the state it was copied from; an arc uv refers to the arc u it came with.

A word is read by its longest arcs first, and by shorter ones where these lead nowhere. Every
beginning of a word has one path, so a place that was reached once and left again is never
tried again, and the work is linear in the length of the word. The labels along the path are
the token ids, and their bytes, joined, are the text again.

Each task reads its own texts; nothing is shuffled.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and arcs, that a task remembers; beyond that many it starts anew.
REMEMBERED = 600_000
#: A longer word is read each time it occurs.
REMEMBERED_BYTES = 64
#: Words of a text that are held at a time.
BLOCK_WORDS = 1 << 16
_HERE = -1
_LONG_TEXT = 1 << 20

# What parts a text into words. White space is what Unicode takes for it.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_of_character() -> dict[str, int]:
    """How the vocabulary file writes bytes: those that print as themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(rest)}


class Automaton:
    """Arcs between the states behind tokens. Tokens are named by their ids."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.label = {token: content for content, token in vocabulary.items()}
        #: For uv: the number of its gadget, and the tokens u and v.
        self._made: dict[int, tuple[int, int, int]] = {}
        #: Arcs that a state lost: (token before, token) to the number of the gadget.
        self._lost: dict[tuple[int, int], int] = {}
        #: Whether there is an arc, for pairs of tokens that were asked for.
        self._known: dict[int, bool] = {}
        #: Contents of tokens that are the one path of their text.
        self.whole = {bytes([byte]): vocabulary[bytes([byte])] for byte in range(256)}
        for number, (left, right) in enumerate(merges):
            self._gadget(number, left, right, vocabulary)
        #: A trie of all tokens: bytes to further nodes, and _HERE to the token that ends at a node.
        self._trie: dict = {}
        for content, token in self.whole.items():
            node = self._trie
            for byte in content:
                node = node.setdefault(byte, {})
            node[_HERE] = token
        self._longest = max(map(len, self.whole))

    def _gadget(self, number: int, left: bytes, right: bytes, vocabulary: dict[bytes, int]) -> None:
        content = left + right
        if content in self.whole:
            raise ValueError(f"two merges make {content!r}")
        if left not in self.whole or right not in self.whole:
            return  # One of the two is on no path, so there is nothing to merge.
        u, v, uv = self.whole[left], self.whole[right], vocabulary[content]
        if not self._has(u, v):
            return
        self._made[uv] = (number, u, v)
        self._lost[u, v] = number
        self.whole[content] = uv

    def _has(self, before: int, token: int) -> bool:
        """Whether the state behind `before` has an arc `token`, from the gadgets built so far."""
        state, until = before, len(self._made) + len(self.label) + 1
        while True:
            arc, since = token, None
            while True:
                lost = self._lost.get((state, arc))
                # An arc goes with the one it came with, if that was lost by then.
                if lost is not None and lost < until and (since is None or lost <= since):
                    return False
                if arc not in self._made:
                    break
                since, arc, _ = self._made[arc]
            if state not in self._made:
                return True
            until, _, state = self._made[state]

    def path(self, word: bytes) -> tuple[int, ...]:
        """Labels along the one path of a word."""
        if word in self.whole:
            return (self.whole[word],)
        known = self._known
        if len(known) >= REMEMBERED:
            known.clear()
        size = len(word)
        labels, reached, options = [], bytearray(size + 1), [self._arcs(word, 0)]
        while True:
            while options[-1]:
                end, token = options[-1].pop()
                if reached[end]:
                    continue
                if labels:
                    pair = labels[-1] << 32 | token
                    has = known.get(pair)
                    if has is None:
                        has = known[pair] = self._has(labels[-1], token)
                    if not has:
                        continue
                labels.append(token)
                if end == size:
                    return tuple(labels)
                reached[end] = True
                options.append(self._arcs(word, end))
                break
            else:
                options.pop()
                labels.pop()

    def _arcs(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Where tokens that begin at a place end, and these tokens, from the shortest on."""
        node, found = self._trie, []
        for end, byte in enumerate(word[at : at + self._longest], at + 1):
            node = node.get(byte)
            if node is None:
                break
            if _HERE in node:
                found.append((end, node[_HERE]))
        return found


class _Words(dict):
    """Paths of words, found when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self._automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        content = word.encode()
        path = self._automaton.path(content)
        if len(content) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = path
        return path


class Tokenizer:
    """A byte-level vocabulary file, compiled."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content["pre_tokenizer"] or {}
        flags = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if (
            model["type"] != "BPE"
            or any(model.get(flag) for flag in flags)
            or content["normalizer"]
            or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space")
            or not split.get("use_regex", True)
        ):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        added = content["added_tokens"]
        if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are found as they are, without regard to what is beside them")
        byte = byte_of_character()
        self.added = {token["content"]: token["id"] for token in added}
        vocabulary = {
            bytes(byte[c] for c in token): number
            for token, number in model["vocab"].items()
            if token not in self.added
        }
        pairs = (merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"])
        merges = [(bytes(byte[c] for c in u), bytes(byte[c] for c in v)) for u, v in pairs]
        self._automaton = Automaton(vocabulary, merges)
        self._paths = _Words(self._automaton)
        self._pattern = regex.compile(WORDS)
        # Of added tokens that begin at one place the longest counts.
        longest = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self._library = ByteLevel(add_prefix_space=False, use_regex=True)
        self._alike: dict[str, bool] = {}
        labels = self._automaton.label | {number: text.encode() for text, number in self.added.items()}
        self._label = [labels.get(number, b"") for number in range(max(labels) + 1)]
        self._decimal = [str(number) for number in range(len(self._label))]

    def _splits_alike(self, character: str) -> bool:
        """Whether the pattern takes a character as the tokenizer's own splitter does. The two
        know different versions of Unicode, and newer characters may differ."""
        if character not in self._alike:
            text = f"a{character}a 1{character}1 !{character}!  {character}{character}x"
            own = [match.span() for match in self._pattern.finditer(text)]
            self._alike[character] = own == [span for _, span in self._library.pre_tokenize_str(text)]
        return self._alike[character]

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, some at a time."""
        if not text.isascii() and not all(map(self._splits_alike, set(text))):
            yield [text[start:end] for _, (start, end) in self._library.pre_tokenize_str(text)]
        elif len(text) <= _LONG_TEXT:
            yield self._pattern.findall(text)
        else:
            matches = self._pattern.finditer(text)
            while block := [match[0] for match in islice(matches, BLOCK_WORDS)]:
                yield block

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some at a time."""
        parts, done = [], 0
        if self._added and any(token in text for token in self.added):
            for found in self._added.finditer(text):
                parts += [(text[done : found.start()], None), ("", self.added[found[0]])]
                done = found.end()
        for part, token in [*parts, (text[done:] if done else text, None)]:
            if token is not None:
                yield [token]
            for words in self._words(part) if part else ():
                yield list(chain.from_iterable(map(self._paths.__getitem__, words)))

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def joined(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self._label.__getitem__, ids))

    def text(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become the replacement character."""
        return self.joined(ids).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of the text decoded from them."""
        number, ids_seen, text_seen = 0, hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.blocks(text):
            if not ids:
                continue
            ids_seen.update((("," if number else "") + ",".join(map(self._decimal.__getitem__, ids))).encode())
            text_seen.update(decoder.decode(self.joined(ids)).encode())
            number += len(ids)
        text_seen.update(decoder.decode(b"", True).encode())
        return number, ids_seen.hexdigest(), text_seen.hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """Compiled once in each Python worker."""
    return Tokenizer(path)


def token_ids(text: Column, path: str) -> Column:
    """Ids of each text, as an array; null for null."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        ids_of = tokenizer(path).ids
        made = [None if text is None else ids_of(text) for text in texts.to_pylist()]
        return pa.array(made, pa.list_(pa.int32()))

    return encoded(text)


def decoded_text(ids: Column, path: str) -> Column:
    """Text of each array of ids; null for null."""

    @F.arrow_udf("string")
    def decoded(given: pa.Array) -> pa.Array:
        text_of = tokenizer(path).text
        return pa.array([None if ids is None else text_of(ids) for ids in given.to_pylist()], pa.string())

    return decoded(ids)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `text` and `ids` of every document. Null texts count as empty ones and have no
    ids; repeated rows each give a row. Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("ids", token_ids(F.col("text"), path))


def round_trips(documents: DataFrame, path: str) -> DataFrame:
    """Number of ids of every document, and digests of the ids and of the text they give back.

    Null and empty texts have no ids and give back the empty text. Each input row gives one
    row, whatever its id, and repeated rows equal ones. An added token that stands in a text
    is found there. Other columns are ignored.
    """

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digested(texts: pa.Array) -> pa.Array:
        digests = tokenizer(path).digests
        found = [digests(text.as_py()) for text in texts]
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array([row[at] for row in found], kind) for at, kind in enumerate(kinds)],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), digested(text).alias("r")
    ).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
