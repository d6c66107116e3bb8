"""Token ids of whole texts, with each distinct word encoded once.

BPE never crosses the borders of a tokenizer's own word split. So the split is
made here for texts in printable ASCII and Latin letters, where it is the same,
each distinct word goes through the BPE model of the tokenizers library once and
is looked up after that, with the signs next to it. Any text with another character, or with an added token
where those count, goes through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Printable ASCII, line break, and the Latin characters that neither normalisation nor
# lower-casing turns into several.
_LATIN = [chr(c) for c in range(0xA1, 0x17F) if c not in (0xAD, 0x130, 0x149)]
_ASCII = [chr(c) for c in range(0x20, 0x7F)]


def _those(kind: str) -> str:
    return "".join(re.escape(c) for c in _ASCII + _LATIN if unicodedata.category(c)[0] == kind)


_L, _N = _those("L"), _those("N")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
OTHER_CHARACTER = re.compile(f"[^\n{''.join(map(re.escape, _ASCII + _LATIN))}]")
BYTE_WORDS = re.compile(
    rf" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^ \n{_L}{_N}]+|[ \n]+(?![^ \n])|[ \n]+"
)
LOWER_WORDS = re.compile(rf"[{_L}]+|{_SHORT}|[{_N}]|[^ \n{_L}{_N}]+")
# blanks that belong together although a single one is cut at
JOINED_BLANKS = re.compile(r"[ \n]  |[ \n] \Z")
# words and chunks kept for reuse, half of them the most recent ones
CACHED_WORDS = 600_000
# longer texts are encoded by themselves, piece by piece
LONG_TEXT = 1 << 24


@cache
def _byte_signs() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Recent(dict):
    """Values by key, worked out when a key is first looked up.

    When more than half of the bound is held, what is held becomes the older half; what
    is asked for again moves back.
    """

    def __init__(self, work_out: Callable[[str], bytes], bound: int) -> None:
        super().__init__()
        self._work_out, self._half = work_out, bound // 2
        self._older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        found = self._older.get(key)
        if found is None:
            found = self._work_out(key)
        self[key] = found
        return found


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens.

    With ``added_tokens`` a token that the file adds to its vocabulary, such as
    ``<|endoftext|>``, is found in a text as the library finds it and gives its own id;
    else such strings are ordinary text. ``lowered`` is for a vocabulary that lower-cases
    and drops white space. A text is cut at its blanks, which words never cross, and each
    distinct chunk is cut into words and encoded once.
    """

    def __init__(
        self, path: str, lowered: bool, cached: int = CACHED_WORDS, added_tokens: bool = False
    ) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._added: list[str] = []
        if added_tokens:
            added = self._tokenizer.get_added_tokens_decoder().values()
            self._added = [token.content for token in added]
        else:
            self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self._lowered = lowered
        self._pattern = LOWER_WORDS if lowered else BYTE_WORDS
        self._signs = _byte_signs()
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._four_bytes = [i.to_bytes(4, "little") for i in range(size)].__getitem__
        self._words = _Recent(self._encode_word, cached - cached // 4)
        self._chunks = _Recent(self._encode_chunk, cached // 4)

    def _packed(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._four_bytes, ids))

    def _encode_word(self, word: str) -> bytes:
        if word.isascii():
            spelled = word.replace(" ", self._signs[0x20]).replace("\n", self._signs[0x0A])
        else:
            spelled = word.encode().decode("latin-1").translate(self._signs)
        return self._packed([t.id for t in self._model.tokenize(spelled)])

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._pattern.findall(chunk)))

    def _looked_up(self, forms: list[str], lead: str) -> list[bytes]:
        """Each form cut at single blanks; each distinct chunk is looked up once, ``lead``
        before it, and its ids are laid out by Arrow. Single words need no cutting and are
        kept once, with and without a sign behind them."""
        cut = pc.split_pattern(pa.array(forms, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        words, chunks = self._words, self._chunks
        ids = []
        for chunk in coded.dictionary.to_pylist():
            # most chunks are a word, or one with a sign behind it
            if chunk.isalpha():
                ids.append(words[lead + chunk])
            elif chunk[:-1].isalpha() and chunk[-1] != "\n" and not chunk[-1].isalnum():
                ids.append(words[lead + chunk[:-1]] + words[chunk[-1]])
            else:
                ids.append(chunks[lead + chunk])
        laid = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, ends, data = laid.buffers()
        if data is None:
            return [b""] * len(forms)
        ends = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()]
        view = memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text, in order. Keep the batches moderate; all is held."""
        out: list[bytes] = [b""] * len(texts)
        at, forms = [], []
        for k, text in enumerate(texts):
            form = text.lower() if self._lowered else text
            if OTHER_CHARACTER.search(text) or any(a in text or a in form for a in self._added):
                out[k] = self._packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
            elif len(form) > LONG_TEXT or not self._lowered and JOINED_BLANKS.search(form):
                out[k] = b"".join(map(self._words.__getitem__, self._pattern.findall(form)))
            elif self._lowered:
                at.append(k)
                forms.append(form.replace("\n", " "))
            else:  # the first word has no blank before it
                first, blank, rest = form.partition(" ")
                out[k] = self._chunks[first]
                if blank:
                    at.append(k)
                    forms.append(rest)
        if forms:
            for k, ids in zip(at, self._looked_up(forms, "" if self._lowered else " ")):
                out[k] += ids
        return iter(out)


@cache
def shared_encoder(path: str, lowered: bool, added_tokens: bool = False) -> WordEncoder:
    """One encoder per Python worker, so its words serve all tasks that run there."""
    return WordEncoder(path, lowered, added_tokens=added_tokens)


def in_chunks(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in runs of about so many bytes, turned into Python one by one."""
    ids, texts = batch.columns[:2]
    total = np.cumsum(np.asarray(pc.binary_length(texts)))
    start = 0
    while start < len(texts):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield ids[start:end].to_pylist(), texts[start:end].to_pylist()
        start = end
