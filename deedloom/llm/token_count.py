"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at a character; dynamic programming
carries the best score and the number of pieces to each position. Of equal scores the one whose last piece starts
first stays, as in the tokenizer. A character that is no piece costs the lowest score less 10 and counts as its
UTF-8 bytes (byte fallback). Blanks become the word mark. A text is cut before each mark that follows another character,
where no piece of the vocabulary can lie across (a vocabulary with such a piece is not cut at all); runs of marks stay
together with the word behind them. Each part is worked out once per worker while it stays in a bounded memory.

Edge cases: a null or empty text has no tokens and score 0; texts and words of any length are read whole (long words
are not remembered); repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame

from deedloom.llm.common import columns, map_rows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0
# a piece with a mark inside, a part that can be cut off, a run without marks
ACROSS, PART, WORD = re.compile(f"[^{MARK}]{MARK}"), re.compile(f"{MARK}+[^{MARK}]*"), re.compile(f"[^{MARK}]+")
REMEMBER, LONGEST = 1 << 18, 64


def load(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]


class Counting:
    """Best score and piece count of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.memory: dict[str, tuple[float, int]] = {}
        across = any(ACROSS.search(p) for p, _ in pieces)
        self.parts = (lambda text: [text]) if across else PART.findall

    def viterbi(self, word: str) -> tuple[float, int]:
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end in range(1, n + 1):
            best = None
            # longest first, that is by ascending start
            while match and match[0] + 1 == end:
                length, own = match[1]
                total = score[end - length] + own
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
                match = next(matches, None)
            char = word[end - 1]
            if char not in self.singles:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(char.encode())
            score[end], count[end] = best, pieces
        return score[n], count[n]

    def word(self, word: str) -> tuple[float, int]:
        if len(word) > LONGEST:
            return self.viterbi(word)
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            known = self.memory[word] = self.viterbi(word)
        return known

    def text(self, text: str | None) -> tuple[int, int, float]:
        """Words (runs without marks), tokens and best score of a text."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", MARK)
        parts = Counter(self.parts(marked if marked[0] == MARK else MARK + marked))
        tokens, score = 0, 0.0
        for w, n in parts.items():
            s, c = self.word(w)
            tokens, score = tokens + n * c, score + n * s
        return len(WORD.findall(marked)), tokens, score


_LOADED: dict[str, Counting] = {}


def loaded(tag: str, pieces) -> Counting:
    """One automaton per worker process and vocabulary."""
    if tag not in _LOADED:
        _LOADED.clear()
        _LOADED[tag] = Counting(pieces.value)
    return _LOADED[tag]


def count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_chars, n_words, n_tokens, score.

    The vocabulary is read by the driver (a tokenizer's table, some ten thousand pieces) and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    tag = uuid.uuid4().hex

    def make():
        counting = loaded(tag, shared)

        def step(part: dict) -> list:
            found = [counting.text(t) for t in part["text"]]
            return [part["doc_id"], [len(t or "") for t in part["text"]], *(list(c) for c in zip(*found))]

        return step

    return map_rows(columns(docs, ("doc_id", "long"), ("text", "string")), make, "doc_id long, n_chars long, n_words long, n_tokens long, score double")
