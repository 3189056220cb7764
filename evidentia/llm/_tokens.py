"""Exact token ids by the tokenizers library, with repeated words encoded once."""

from __future__ import annotations

import json
import marshal
import os
import re
import zlib
from functools import lru_cache

import numpy as np

from ._shared import LOWER, ranges, same_spans, word_hash, word_spans

#: A worker remembers the ids of this many words twice over: a full table becomes the older one.
CACHE_WORDS = 200_000
#: Bytes of a word that is remembered.
CACHE_BYTES = 64
#: Words that the library is given at once.
TOGETHER = 2000
#: Bytes of text that one step works on; a larger step meets each word less often.
STEP_BYTES = 2 << 20

SPACE, LETTER, MARK, ODD = range(4)
#: Kinds of bytes. Spaces are the space and the line feed; marks are ASCII punctuation without apostrophe, `<`, `|` and `_`.
KIND = np.full(256, ODD, np.uint8)
KIND[[0x20, 0x0A]] = SPACE
KIND[65:91] = KIND[97:123] = LETTER
KIND[[ord(c) for c in r"""!"#$%&()*+,-./:;=>?@[\]^`{}~"""]] = MARK
#: Lead bytes of U+00C0 to U+017F, which are letters but for two signs; dotted capital I is left out with them.
LEADS = (0xC3, 0xC4, 0xC5)
NOT_LETTERS = (0xC397, 0xC3B7, 0xC4B0)
WORD_TAG, MARK_TAG, RAW_TAG = 0, 1, 2


def kinds(data: np.ndarray) -> np.ndarray:
    out = KIND[data]
    lead = np.flatnonzero((data >= LEADS[0]) & (data <= LEADS[-1]))
    if len(lead):
        pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
        good = lead[~np.isin(pair, NOT_LETTERS)]
        out[good] = out[good + 1] = LETTER
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z and U+00C0 to U+00DE in lower case; the library lowers the rest."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = second[(data[second] <= 0x9E) & (data[second] != 0x97)]
    out[high] += 0x20
    return out


class Encoder:
    """Ids of texts without added special tokens, little-endian.

    If the vocabulary drops white space and ends words by a suffix, a text's ids are the ids of its
    chunks between spaces in turn: normalisation, splitting and merging never look across a space.
    A chunk of letters and trailing punctuation is the ids of both parts. Any other chunk goes to the
    library as it is, and so do whole texts of every other kind of vocabulary. Words of a step with equal
    64-bit hashes are compared by their bytes; each different one is looked up, or encoded, once.

    proof: what `prove` returned for this vocabulary, so that a worker need not prove it again.
    """

    def __init__(self, path: str, proof: bytes | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.suffix = held["model"].get("end_of_word_suffix") or ""
        normal = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (held.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = (
            bool(self.suffix) and normal == ["NFC", "Replace", "Lowercase"] and len(split) == 1
            and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s\p{L}\p{N}]+" in split[0]["pattern"]["Regex"]
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in held["added_tokens"])
        )
        self.ends = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.ends[i] = bool(self.suffix) and token.endswith(self.suffix)
        self.whole: dict[bytes, bytes] = {}
        if self.by_word:
            self.whole = dict(self._stems() if proof is None else marshal.loads(zlib.decompress(proof)))
        # What is known of words: the proven ones and what was merged since; and the older generation of these.
        self.known, self.old = dict(self.whole), {}

    def _stems(self) -> list[tuple[bytes, bytes]]:
        """Strings of the vocabulary that the library, given each alone, encodes as one token, as (key, id): the keys
        that `_pieces` makes of them, whatever they consist of."""
        stems = sorted({s for t in self.library.get_vocab(with_added_tokens=False) if t.endswith(self.suffix) and (s := t.removesuffix(self.suffix)) and not re.search("[ \n]", s)})
        data = np.frombuffer("".join(stems).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(s.encode()) for s in stems)])
        kind, low = kinds(data), lowered(data).tobytes()
        out = []
        for s, a, b, ids in zip(stems, offsets[:-1].tolist(), offsets[1:].tolist(), self._plain(stems), strict=True):
            if len(ids) != self.dtype.itemsize:
                continue
            letters = (kind[a:b] == LETTER).all()
            if not letters and not (kind[a:b] == ODD).any() and kind[a] == LETTER:
                continue  # letters with marks behind are taken as two pieces
            out.append((low[a:b] if letters else b"\2" + s.encode(), ids))
            if (kind[a:b] == MARK).all():
                out.append((b"\1" + s.encode(), ids))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded as one text, cut behind the ids that end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                out += self._plain(some)
                continue
            data, ends = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _look_up(self, keys: list[bytes]) -> list[bytes]:
        """Ids of words by their keys: a word of letters is its own, others have their tag in front."""
        out: list = list(map(self.known.get, keys))
        missing = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := self.old.get(keys[i])) is None:
                missing.append(i)
            else:
                out[i] = self.known[keys[i]] = ids
        words = [i for i in missing if keys[i][0] > RAW_TAG]
        others = [i for i in missing if keys[i][0] <= RAW_TAG]
        for some, ids in ((words, self._words([keys[i].decode() for i in words])), (others, self._plain([keys[i][1:].decode() for i in others]))):
            for i, x in zip(some, ids, strict=True):
                out[i] = x
                if len(keys[i]) <= CACHE_BYTES:
                    self.known[keys[i]] = x
        if len(self.known) > len(self.whole) + CACHE_WORDS:
            self.known, self.old = dict(self.whole), self.known
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Words of the texts in turn: which different word each is, the ids of those, and each text's first word."""
        kind = kinds(data)
        starts, ends, first = word_spans(kind != SPACE, offsets)
        letters, odd = np.zeros(len(kind) + 1, np.int32), np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == LETTER, out=letters[1:])
        np.cumsum(kind == ODD, out=odd[1:])
        core = starts + letters[ends] - letters[starts]
        plain = (odd[ends] == odd[starts]) & (core > starts) & (letters[core] - letters[starts] == core - starts)
        core[~plain] = ends[~plain]
        low = lowered(data)
        two = core < ends
        at = np.arange(len(starts)) + np.cumsum(two) - two
        n = len(starts) + int(two.sum())
        a, b, tag = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.uint8)
        a[at], b[at], tag[at] = starts, core, np.where(plain, WORD_TAG, RAW_TAG)
        a[at[two] + 1], b[at[two] + 1], tag[at[two] + 1] = core[two], ends[two], MARK_TAG
        raw, tags = tag == RAW_TAG, (b"", b"\1", b"\2")
        h = word_hash(low, a, b)
        h[raw] = word_hash(data, a[raw], b[raw])
        h += tag
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        text, raw_text = low.tobytes(), data.tobytes()
        rep = one[which]
        same = (tag == tag[rep]) & same_spans(low, a, b, a[rep], b[rep])
        same[raw] &= same_spans(data, a[raw], b[raw], a[rep[raw]], b[rep[raw]])
        if not same.all():  # two words share a hash: told apart by their bytes alone
            held: dict[bytes, int] = {}
            which = np.array([held.setdefault(tags[t] + (raw_text if t == RAW_TAG else text)[x:y], len(held)) for t, x, y in zip(tag.tolist(), a.tolist(), b.tolist(), strict=True)], np.int64)
            return which, self._look_up(list(held)), np.searchsorted(a, offsets)
        keys = [text[x:y] if not t else tags[t] + (raw_text if t == RAW_TAG else text)[x:y] for t, x, y in zip(tag[one].tolist(), a[one].tolist(), b[one].tolist(), strict=True)]
        return which, self._look_up(keys), np.searchsorted(a, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and where each begins), and where each text's ids begin."""
        if not self.by_word or not len(data):
            whole = data.tobytes()
            found = self._plain([whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.frombuffer(b"".join(found), self.dtype), np.cumsum([0, *map(len, found)]) // self.dtype.itemsize
        which, found, first = self._pieces(data, offsets)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(found), self.dtype)
        each = sizes[which]
        return ids[ranges((np.cumsum(sizes) - sizes)[which], each)], np.concatenate([[0], np.cumsum(each)])[first]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ids of each text, counted: words proven to be whole tokens are one, the others are merged once each."""
        if not self.by_word or not len(data):
            return np.diff(self.encode(data, offsets)[1])
        which, found, first = self._pieces(data, offsets)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return np.diff(np.concatenate([[0], np.cumsum(sizes[which])])[first])


@lru_cache(maxsize=2)
def prove(path: str) -> bytes:
    """The strings of a vocabulary that are one token each, proven once on the driver; bounded by the vocabulary."""
    return zlib.compress(marshal.dumps(list(Encoder(path).whole.items())))


@lru_cache(maxsize=2)
def encoder(path: str, proof: bytes | None = None) -> Encoder:
    return Encoder(path, proof)
