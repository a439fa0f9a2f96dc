"""Byte-pair encoding as a streaming transducer, decoding as a state machine, and token counts.

The merges of a vocabulary file are applied by rank. What comes after a place in a word can change tokens
only a bounded way to its left, because a change spreads to the left by merges of ever later rank; the
longest such chain, worked out from the merge list, is the lookahead. The transducer holds that many
bytes and a block, and emits tokens once they are further than that from the end of what it has seen.
Every word goes through it; short words are remembered. A text is read in pieces of about SPAN characters,
and a word that runs over their ends is given to one transducer piece by piece, so memory does not grow
with a text or a word.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Words of more bytes than this are not remembered.
LONG = 64
#: Bytes that the transducer takes at once, besides the lookahead.
BLOCK = 256
#: Words, and chunks between blanks, remembered by each Python worker: some 200 bytes each.
MEMO = 1 << 18
MEMO_CHUNKS = 1 << 19
#: Characters of a text worked on at once.
SPAN = 1 << 13
#: Characters after a word that can still change where it ends, unless it is a run of one class.
AHEAD = 3

_NO_RULE = 1 << 60
#: White space as Unicode defines it (``str.isspace`` has four control characters more).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WS}])[{_WS}]")
_DOUBLE = re.compile(f"[{_WS}][{_WS}]")
_CONTROL_SPACE = re.compile(r"[\x1c-\x1f]")
#: Letters and signs that never compose with what stands before them: a text may be cut there and normalised in parts.
_APART = re.compile("[!-~\u00c0-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0904-\u0939\u0e01-\u0e2e\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\U0001f300-\U0001f64f]")
#: The split of byte-level vocabularies whose file asks for the default one.
_DEFAULT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From here on versions of Unicode differ in what is a letter or a number.
_WIDE = re.compile("[\u0530-\U0010ffff]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@functools.cache
def library_class(name: str) -> str:
    """The tokenizers library's own members of \\p{name}, as ranges for a set in brackets.

    Its Unicode version is not that of the regex module, so the classes are read off it.
    """
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    maybe = sorted({*regex.findall(rf"\p{{{name}}}", every), *(c for c in every if unicodedata.category(c)[0] == name)})
    found = sorted(ord(c) for c, _ in Split(Regex(rf"\p{{{name}}}"), "removed", invert=True).pre_tokenize_str("".join(maybe)))
    ends = [i for i, (a, b) in enumerate(zip(found, found[1:], strict=False)) if b != a + 1] + [len(found) - 1]
    starts = [0] + [i + 1 for i in ends[:-1]]
    return "".join(f"\\U{found[a]:08x}-\\U{found[b]:08x}" for a, b in zip(starts, ends, strict=True))


class Splitter:
    """Finds the words of a text by the vocabulary's pattern."""

    def __init__(self, pattern: str, letters: str, numbers: str) -> None:
        import regex

        own = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        self.plain = regex.compile(pattern).findall
        self.wide = regex.compile(own).findall
        self.each = regex.compile(own).finditer
        self.runs = [regex.compile(x) for x in (rf"[{letters}]+", rf"[{numbers}]+", rf"[^\s{letters}{numbers}]+", r"\s+")]

    def __call__(self, text: str) -> list[str]:
        return (self.wide if not text.isascii() and _WIDE.search(text) else self.plain)(text)


class Memo(dict):
    """Remembers what ``make`` returns for short keys, the last ``limit`` new ones at least and twice as many at most.

    When it is full it starts anew, and what is used again is taken over from what it was before.
    """

    def __init__(self, make: Callable, limit: int = MEMO) -> None:
        super().__init__()
        self.make, self.limit = make, limit
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Tokens and merges of a vocabulary file (JSON), with what its text splitting asks for."""

    def __init__(self, source: str, letters: str | None = None, numbers: str | None = None) -> None:
        """``letters`` and ``numbers`` are ``library_class`` of L and N, where they are known already."""
        file = json.loads(source)
        model = file["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        chars = byte_chars()
        self.first = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.suffix] for c in chars]
        self.rules: list[tuple[int, int, int]] = []
        self.rank: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rule = self.ids[a], self.ids[b], self.ids[a + b]
            self.rules.append(rule)
            self.rank.setdefault(rule[:2], n)
        self.size = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in self.ids.items()}
        self._require_proper()
        self.lookahead = self._lookahead()
        parts = [file.get("normalizer") or {}]
        parts = parts[0].get("normalizers", parts)
        self.lower = any(x.get("type") == "Lowercase" for x in parts)
        self.compose = any(x.get("type") == "NFC" for x in parts)
        splits = file["pre_tokenizer"].get("pretokenizers", [file["pre_tokenizer"]])
        own = [x["pattern"]["Regex"] for x in splits if x["type"] == "Split"]
        self.split = own[0] if own else _DEFAULT_SPLIT
        self.find = Splitter(self.split, letters or library_class("L"), numbers or library_class("N"))
        self.joined = file.get("decoder") is None
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def normal(self, text: str) -> str:
        """Composed, lower-case text; rarer characters by the library, whose Unicode version is another."""
        if not text.isascii():
            if _WIDE.search(text):
                from tokenizers import normalizers

                steps = [normalizers.NFC()] * self.compose + [normalizers.Lowercase()]
                return normalizers.Sequence(steps).normalize_str(text)
            if self.compose:
                text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a final sigma is like any other

    def _require_proper(self) -> None:
        """Every merge joins tokens that exist before it and makes one that no other makes; else ranks don't rise."""
        made = {*self.first, *self.last}
        for a, b, new in self.rules:
            if a not in made or b not in made or new in made:
                raise ValueError("the merges are not in the order in which they were learned")
            made.add(new)

    def _lookahead(self) -> int:
        """Bytes to the left of unknown text that it can still change.

        reach[t]: how far a change spreads to the left from a token t that starts the changed part, by
        merges of later rank. A merge (a, b) with b there takes a into the changed part, which then starts
        with a or ab; a merge with a there makes it start with ab.
        """
        reach: dict[int, int] = {}
        most = 0
        for a, b, new in reversed(self.rules):
            grown = reach.get(new, 0)
            far = self.size[a] + max(reach.get(a, 0), grown)
            reach[b] = max(reach.get(b, 0), far)
            reach[a] = max(reach.get(a, 0), grown)
            most = max(most, far)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a run of single bytes: the lowest rank first, from left to right."""
        get, rules = self.rank.get, self.rules
        ranks = list(map(get, zip(ids, ids[1:], strict=False), repeat(_NO_RULE)))
        while ranks and (least := min(ranks)) != _NO_RULE:
            i = ranks.index(least)
            ids[i : i + 2] = (new := rules[least][2],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), _NO_RULE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), _NO_RULE)
        return ids

    def word(self, data: bytes) -> list[int]:
        """Tokens of one word, by a transducer."""
        coder = Transducer(self)
        out = []
        for start in range(0, len(data), BLOCK):
            out += coder.push(data[start : start + BLOCK])
        return out + coder.end()


class Transducer:
    """Encodes one word given piece by piece, in memory that does not grow with the word."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.held = b""

    def push(self, data: bytes) -> list[int]:
        """Take more bytes; returns the tokens that no further bytes can change."""
        v = self.vocabulary
        self.held += data
        sure = len(self.held) - 1 - v.lookahead  # the last byte may be the end of the word
        if sure < BLOCK:
            return []
        out, at = [], 0
        for token in v.merge([v.first[b] for b in self.held]):
            if at + v.size[token] > sure:
                break
            at += v.size[token]
            out.append(token)
        self.held = self.held[at:]
        return out

    def end(self) -> list[int]:
        v, data = self.vocabulary, self.held
        self.held = b""
        return v.merge([*(v.first[b] for b in data[:-1]), v.last[data[-1]]]) if data else []


class Decoder:
    """Tokens to text, piece by piece. A vocabulary without a decoder shows its tokens, joined by blanks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.joined = vocabulary.joined
        if self.joined:
            self.piece = {i: b" " + t.encode() for i, t in vocabulary.tokens.items()}
            self.begun = False
        else:
            of = {c: b for b, c in enumerate(byte_chars())}
            self.piece = {i: bytes(of[c] for c in t) for i, t in vocabulary.tokens.items()}
            self.begin()

    def begin(self) -> None:
        self.begun = False
        self.state = None if self.joined else codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int], last: bool = False) -> bytes:
        """UTF-8 of the text that these tokens add; an unfinished character waits for its next byte."""
        data = b"".join(map(self.piece.__getitem__, ids))
        if self.state is not None:
            return self.state.decode(data, last).encode()
        if not self.begun and data:
            self.begun, data = True, data[1:]
        return data


def spans(text: str) -> Iterator[tuple[str, bool]]:
    """The text in pieces of SPAN characters or a little more, and whether a word surely ends there.

    Pieces end before white space that follows none, else before a character that composes with none
    before it; text without either stays in one piece.
    """
    at = 0
    while len(text) - at > SPAN:
        cut = _CUT.search(text, at + SPAN, at + 2 * SPAN)
        sure = cut is not None
        cut = cut or _APART.search(text, at + SPAN)
        if cut is None:
            break
        yield text[at : cut.start()], sure
        at = cut.start()
    yield text[at:] if at else text, True


class Runner:
    """Words of a text that comes in pieces which may end inside a word.

    ``word`` is called for each whole word, ``tokens`` for what a transducer emits of a word that is longer
    than a piece; what they return is yielded.
    """

    def __init__(self, vocabulary: Vocabulary, word: Callable, tokens: Callable) -> None:
        self.vocabulary, self.word, self.tokens = vocabulary, word, tokens
        self.tail = ""
        self.run = self.coder = None

    def feed(self, piece: str, last: bool) -> Iterator:
        v = self.vocabulary
        text, at = self.tail + (v.normal(piece) if v.lower else piece), 0
        self.tail = ""
        if self.run is not None:
            at = yield from self._carry(text, 0, last)
            if self.run is not None:
                return
        sure = len(text) if last else len(text) - AHEAD
        for m in v.find.each(text, at):
            if m.end() > sure:
                break
            yield self.word(m[0])
            at = m.end()
        else:
            m = None
        if last:
            return
        self.tail = text[m.start() if m else at :]
        if m and m.end() - m.start() > SPAN // 2:  # one run of a class
            text, self.tail = self.tail, ""
            skip = int(text[0] == " " and not text[1].isspace())
            self.run = next(r for r in v.find.runs if r.match(text, skip))
            self.coder = Transducer(v)
            yield self.tokens(self.coder.push(text[:skip].encode()))
            at = yield from self._carry(text, skip, False)
            self.tail = text[at:]

    def _carry(self, text: str, start: int, last: bool) -> Iterator:
        """Give the transducer what goes on with the run; returns where the run ends."""
        m = self.run.match(text, start)
        end = m.end() if m else start
        if self.run is self.vocabulary.find.runs[3] and not (last and end == len(text)):
            end = max(start, end - 1)  # the last white space may go with the next word
            over = m is None or m.end() < len(text)
        else:
            over = last or end < len(text)
        for at in range(start, end, BLOCK):
            yield self.tokens(self.coder.push(text[at : min(end, at + BLOCK)].encode()))
        if over:
            yield self.tokens(self.coder.end())
            self.run = self.coder = None
        else:
            self.tail = text[end:]
        return end


class Encoder:
    """Text to packed little-endian 32-bit ids, equal to the library's without begin and end tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = v = vocabulary
        self.words = Memo(lambda w: packed(v.word(w.encode())))
        words, find = self.words.__getitem__, v.find
        self.chunks = Memo(lambda c: b"".join(map(words, find(c))), MEMO_CHUNKS)
        self.spaced = Memo(lambda c: b"".join(map(words, find(" " + c))), MEMO_CHUNKS)

    def encode(self, text: str) -> Iterator[bytes]:
        for part, special in self.parts(text):
            if special is not None:
                yield special.to_bytes(4, "little")
            elif part:
                yield from pieced(part, self.vocabulary, self.span, self.words.__getitem__, packed)

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text, and added tokens with their id, in turn."""
        at = 0
        if self.vocabulary.special is not None:
            for m in self.vocabulary.special.finditer(text):
                yield text[at : m.start()], None
                yield m[0], self.vocabulary.added[m[0]]
                at = m.end()
        yield text[at:] if at else text, None

    def span(self, text: str) -> bytes:
        v = self.vocabulary
        if v.lower:  # white space is dropped, so chunks between it are independent
            text = v.normal(text)
            if _CONTROL_SPACE.search(text):
                return b"".join(map(self.words.__getitem__, v.find(text)))
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if _DOUBLE.search(text):
            return b"".join(map(self.words.__getitem__, v.find(text)))
        head, *rest = text.split(" ")  # every other chunk has a blank before it, and no white space meets it
        return b"".join(map(self.words.__getitem__, v.find(head))) + b"".join(map(self.spaced.__getitem__, rest))


def pieced(text: str, vocabulary: Vocabulary, span: Callable, word: Callable, tokens: Callable) -> Iterator:
    """``span`` of each piece of the text that holds whole words, ``word`` and ``tokens`` of what runs over the ends of pieces."""
    runner = None
    for piece, sure in spans(text):
        if runner is None and sure:
            yield span(piece)
        else:
            runner = runner or Runner(vocabulary, word, tokens)
            yield from runner.feed(piece, sure)
            runner = None if sure else runner


def packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Counter:
    """Numbers of tokens, with whole-token words looked up in a table.

    The table (``whole``: ids) is proved once, apart from the corpus, by ``whole_tokens``; without it, it is
    proved here.
    """

    def __init__(self, vocabulary: Vocabulary, whole: Iterable[int] | None = None) -> None:
        self.parts = Encoder(vocabulary).parts
        self.vocabulary = v = vocabulary
        self.find = find = v.find
        self.whole = whole = frozenset(token_bytes(v, i).decode() for i in (whole_tokens(v) if whole is None else whole))
        self.merged = Memo(lambda w: len(v.word(w.encode())))
        merged = self.merged

        def count(words: list[str]) -> int:
            return sum(1 if w in whole else merged[w] for w in words)

        self.count = count
        self.spaced = Memo(lambda c: count(find(" " + c)), MEMO_CHUNKS)

    def __call__(self, text: str) -> int:
        n = 0
        for part, special in self.parts(text):
            if special is not None:
                n += 1
            elif part:
                n += sum(pieced(part, self.vocabulary, self.span, lambda w: self.count((w,)), len))
        return n

    def span(self, text: str) -> int:
        if _DOUBLE.search(text):
            return self.count(self.find(text))
        head, *rest = text.split(" ")
        return self.count(self.find(head)) + sum(map(self.spaced.__getitem__, rest))


@functools.cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


def token_bytes(v: Vocabulary, i: int) -> bytes:
    return bytes(map(_byte_of().__getitem__, v.tokens[i]))


def whole_tokens(v: Vocabulary) -> list[int]:
    """The tokens whose bytes are UTF-8 and which the merges, run on these bytes, give as exactly one token."""
    if v.suffix or v.lower:
        raise ValueError("whole tokens are proved for byte-level vocabularies only")
    found = []
    for i in v.ids.values():
        data = token_bytes(v, i)
        if v.word(data) == [i]:
            try:
                data.decode()
            except UnicodeDecodeError:
                continue
            found.append(i)
    return found


_loaded: dict[tuple[str, str], object] = {}


def loaded(kind: type, sent, key: str, *more):
    """One ``kind`` (Encoder, Counter, Decoder, ...) of a broadcast vocabulary in each Python worker."""
    if (kind.__name__, key) not in _loaded:
        if ("vocabulary", key) not in _loaded:
            _loaded[("vocabulary", key)] = Vocabulary(*sent.value)
        _loaded[(kind.__name__, key)] = kind(_loaded[("vocabulary", key)], *more)
    return _loaded[(kind.__name__, key)]


@functools.cache
def proved_table(source: str) -> list[int]:
    """``whole_tokens`` of a vocabulary file, proved on the driver once a session."""
    return whole_tokens(Vocabulary(source, library_class("L"), library_class("N")))


def send_vocabulary(df: DataFrame, path: str) -> tuple[object, str]:
    """The vocabulary file as a broadcast (a fixed file of a few MB, read where the driver runs) and its key."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    sent = source, library_class("L"), library_class("N")
    return df.sparkSession.sparkContext.broadcast(sent), hashlib.sha256(source.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "ids") -> DataFrame:
    """``keep`` and the token ids (array<int>) of every whole text; null and empty texts have none.

    ``path`` is the vocabulary file, in the JSON of the tokenizers library. Rows are independent of each
    other, so repeated rows and null ids are encoded like others; an empty table gives no rows; extra
    columns are not read. The ids of a very long text are one value, which grows with it.
    """
    sent, key = send_vocabulary(docs, path)

    def make() -> Callable[[str], tuple]:
        import numpy as np

        encoder = loaded(Encoder, sent, key)
        return lambda body: (np.frombuffer(b"".join(encoder.encode(body)), "<u4").astype("i4"),)

    return map_texts(docs, text, keep, f"{name} array<int>", make, as_bytes=False)


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), name: str = "text") -> DataFrame:
    """``keep`` and the text of every row's token ids, special tokens included; null and empty ids give an empty text.

    Repeated rows are decoded like others; an empty table gives no rows; extra columns are not read.
    """
    sent, key = send_vocabulary(rows, path)

    def make() -> Callable[[list[int]], tuple]:
        decoder = loaded(Decoder, sent, key)

        def call(tokens: list[int]) -> tuple[str]:
            decoder.begin()
            return (decoder.push(tokens or [], last=True).decode(),)

        return call

    return map_texts(rows, ids, keep, f"{name} string", make, as_bytes=False)


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded span by span.

    Null and empty texts have no tokens and the digests of nothing. Ids are digested as little-endian
    unsigned 32-bit integers, the decoded text as UTF-8. Rows are independent of each other, so repeated rows
    and null ids are treated like others; an empty table gives no rows; extra columns are not read. A very
    long text, and a very long word in it, pass through in pieces.
    """
    sent, key = send_vocabulary(docs, path)

    def make() -> Callable[[str], tuple]:
        import numpy as np

        encoder, decoder = loaded(Encoder, sent, key), loaded(Decoder, sent, key)

        def call(body: str) -> tuple[int, str, str]:
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            decoder.begin()
            for packed in encoder.encode(body):
                n += len(packed) // 4
                ids.update(packed)
                decoded.update(decoder.push(np.frombuffer(packed, "<u4").tolist()))
            decoded.update(decoder.push((), last=True))
            return n, ids.hexdigest(), decoded.hexdigest()

        return call

    return map_texts(docs, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, as_bytes=False)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    Null and empty texts have no bytes and no tokens. Strings of special tokens count as these tokens.
    Rows are independent of each other, so repeated rows and null ids are counted like others; an empty
    table gives no rows; extra columns are not read. A very long text passes through in pieces. The table of
    whole tokens, one number for each token of the vocabulary at most, is proved on the driver.
    """
    sent, key = send_vocabulary(docs, path)
    with open(path, encoding="utf-8") as f:
        whole = docs.sparkSession.sparkContext.broadcast(proved_table(f.read()))

    def make() -> Callable[[str], tuple]:
        count = loaded(Counter, sent, key, whole.value)
        return lambda body: (len(body.encode()), n := count(body), n > limit)

    return map_texts(docs, text, keep, "n_bytes long, n_tokens long, over_limit boolean", make, as_bytes=False)
