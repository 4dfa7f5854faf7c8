"""Exact token ids of whole texts, with words encoded once and remembered."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import compress

import pyarrow as pa

#: Words in each of the two generations of a worker's memory (about 160 bytes a word).
MEMO_WORDS = 380_000
#: Words beyond this length are encoded but not remembered.
MEMO_CHARS = 64
#: Words that go to the library as one text.
JOINED_WORDS = 2_000
#: Characters of texts whose words are looked up together.
ROUND_CHARS = 8 << 20

#: A word of Latin letters (all of them letters in any version of Unicode, lower-cased to one letter:
#: not so U+0130) and signs that may follow it: ASCII's and general punctuation's, none of which a normalizer
#: joins to what stands before it. Combining marks are no such signs: NFC makes one letter of e and U+0301.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^`{}~" + "".join(map(chr, range(0x2010, 0x2028)))
_STEM = re.compile(f"[{_LETTERS}]+")


def _plain(stem: str) -> bool:
    """Whether a word without the signs after it is Latin letters; ASCII's need no pattern."""
    return stem.isalpha() if stem.isascii() else _STEM.fullmatch(stem) is not None


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer, held to one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo:
    """Values by word in two generations: when the young one is full, the old one goes and the young one grows old."""

    def __init__(self):
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.long: list[str] = []

    def age(self) -> None:
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Of distinct words those in neither generation; those in the old one become young again."""
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        if old:
            held = [w in old for w in new]
            known = list(compress(new, held))
            young.update(zip(known, map(old.__getitem__, known)))
            new = [w for w, h in zip(new, held) if not h]
        self.long += [w for w in new if len(w) > MEMO_CHARS]
        return new

    def forget_long(self) -> None:
        for w in self.long:
            self.young.pop(w, None)
        self.long.clear()


class WordMemo:
    """Encodes texts with the tokenizers library, each distinct word once.

    A text is cut at U+0020. Byte-level vocabularies split words before a single
    space between two characters that aren't white space, whatever stands
    around it, so the ids of " word" don't depend on the rest; a text with other
    white space at a cut goes to the library whole. With `spaces_dropped` the
    vocabulary's own splitter removes white space, and every cut is safe.
    Neither kind has an added token that holds a space.

    New words go to the library many at a time. Words of Latin letters are
    joined as running text, and a token that starts (byte-level) or ends a word
    tells them apart; signs after such a word are split off by either
    vocabulary's splitter and are looked up on their own. Other words, as
    those with combining marks, stay whole and are joined by an added token, at
    which the library splits before all else. Ids are little-endian unsigned
    16-bit integers: the vocabulary is below 65,536.
    """

    def __init__(self, path: str, spaces_dropped: bool):
        import numpy as np

        self.tok = load_tokenizer(path)
        size = self.tok.get_vocab_size()
        assert size <= 65_536
        added = self.tok.get_added_tokens_decoder()
        self.between, self.between_id = next((t.content, k) for k, t in added.items() if t.content.startswith("<|"))
        self.dropped = spaces_dropped
        self.edge = np.zeros(size, bool)
        for token, k in self.tok.get_vocab().items():
            self.edge[k] = token.endswith("</w>") if spaces_dropped else token.startswith("\u0120")
        self.head = _Memo()
        self.tail = self.head if spaces_dropped else _Memo()
        self.signs: dict[str, bytes] = {}
        self.rounds = 0

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of any words without an added token."""
        import numpy as np

        out: list[bytes] = []
        for ids in self._library([self.between.join(words[k : k + JOINED_WORDS]) for k in range(0, len(words), JOINED_WORDS)]):
            cuts = np.flatnonzero(np.frombuffer(ids, "<u2") == self.between_id) * 2
            out += [ids[a:b] for a, b in zip([0, *(cuts + 2).tolist()], [*cuts.tolist(), len(ids)])]
        return out

    def _running(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each after a space."""
        import numpy as np

        out: list[bytes] = []
        for ids in self._library([" " + " ".join(words[k : k + JOINED_WORDS]) for k in range(0, len(words), JOINED_WORDS)]):
            edges = np.flatnonzero(self.edge[np.frombuffer(ids, "<u2")])
            cuts = ((edges + 1) if self.dropped else np.append(edges[1:], len(ids) // 2)) * 2
            at = 0
            for to in cuts.tolist():
                out.append(ids[at:to])
                at = to
        return out

    def _learn(self, memo: _Memo, words: Iterable[str], lead: str) -> None:
        new = memo.missing(words)
        if not new:
            return
        rest = new
        if lead or self.dropped:
            cut = [(w, w.rstrip(_SIGNS)) for w in new]
            latin = [_plain(stem) for _, stem in cut]
            rest = [w for w, ok in zip(new, latin) if not ok]
            plain = list(compress(cut, latin))
            bare = [w for w, stem in plain if len(stem) == len(w)]
            signed = [(w, stem, w[len(stem) :]) for w, stem in plain if len(stem) < len(w)]
            for sign in {sign for _, _, sign in signed}.difference(self.signs):
                self.signs[sign] = self._library([sign])[0]
            stems = bare + memo.missing({stem for _, stem, _ in signed}.difference(bare))
            memo.young.update(zip(stems, self._running(stems), strict=True))
            known, signs = memo.young, self.signs
            known.update([(w, known[stem] + signs[sign]) for w, stem, sign in signed])
            if len(signs) > MEMO_WORDS:
                signs.clear()
        odd = [w for w in rest if "<|" in w]  # may hold an added token
        if odd:
            memo.young.update(zip(odd, self._library([lead + w for w in odd]), strict=True))
            rest = [w for w in rest if "<|" not in w]
        memo.young.update(zip(rest, self._apart([lead + w for w in rest]), strict=bool(rest)))
        if not self.dropped:
            for w in rest + odd:
                if not w or w[0].isspace() or w[-1].isspace():
                    memo.young[w] = None

    def _round(self, texts: Sequence[str | None]) -> list[bytes]:
        import numpy as np
        import pyarrow.compute as pc

        for memo in (self.head, self.tail):
            memo.age()
        cut = pc.split_pattern(pa.array([t or "" for t in texts], pa.string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.tail, words, "" if self.dropped else " ")
        values = list(map(self.tail.young.__getitem__, words))
        if not self.dropped:  # a text's first word has no space before it
            heads = [words[k] for k in codes[ends[:-1]]]
            self._learn(self.head, set(heads), "")
            codes = codes.copy()
            codes[ends[:-1]] = np.arange(len(words), len(words) + len(heads))
            values += map(self.head.young.__getitem__, heads)
        # cuts beside other white space, or at an end of it: such texts go to the library whole
        whole = np.zeros(len(texts), bool)
        if None in values:
            bad = np.array([v is None for v in values])
            values = [v or b"" for v in values]
            whole = np.add.reduceat(bad[codes], ends[:-1]) > 0
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        to = np.cumsum(n)
        places = np.repeat(first[codes] - (to - n), n)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(values), "<u2")[places].tobytes()
        stops = np.append(0, to)[ends] * 2
        out = [ids[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]
        for k in np.flatnonzero(whole):
            out[k] = self._library([texts[k] or ""])[0]
        for memo in (self.head, self.tail):
            memo.forget_long()
        self.rounds += 1
        if self.rounds % 4 == 0:
            del cut, coded
            pa.default_memory_pool().release_unused()
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        out: list[bytes] = []
        at, chars = 0, 0
        collects = gc.isenabled()
        gc.disable()  # a round makes many lists and no cycles
        try:
            for k, t in enumerate(texts):
                chars += len(t or "") + 1
                if chars > ROUND_CHARS:
                    out += self._round(texts[at : k + 1])
                    at, chars = k + 1, 0
            return out + self._round(texts[at:]) if at < len(texts) else out
        finally:
            if collects:
                gc.enable()


@lru_cache(maxsize=2)
def word_memo(path: str, spaces_dropped: bool) -> WordMemo:
    """A worker's own, kept from task to task."""
    return WordMemo(path, spaces_dropped)


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text: one row at least, so long texts stand alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, n = 0, len(ends)
        while at < n:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
