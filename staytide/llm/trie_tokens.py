"""Token counts by unigram segmentation, shared over the prefixes of a trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import in_slices

SPACE_MARK = "▁"
#: A task starts a new trie when its trie holds so many nodes (some hundred MB).
MAX_NODES = 1_000_000
#: Longer pre-tokens hardly share a prefix; they are scored without a node per character.
LONG_WORD = 256


def unigram_scores(path: str) -> dict[str, float]:
    """Piece scores from a public piece vocabulary: the file ranks its pieces,
    and a piece's log probability follows Zipf's law over the ranks. Control
    and byte pieces and those the file never forms by itself are left out."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e6]
    whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {p: -math.log(r + 1) - whole for r, p in enumerate(ranked)}


class SegmentTrie:
    """Trie of pre-tokens whose nodes hold the best forward score of their prefix.

    A node's score is the maximum over the vocabulary pieces that end its prefix
    of the score where the piece starts plus the piece's; it depends on the
    prefix alone, so words with a common beginning share the work. A character
    that no piece covers costs one token per UTF-8 byte. Ties go to fewer
    tokens. ``terminal`` keeps the counts of whole pre-tokens as long as their trie.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        # Endings of pieces, with the score of those that are whole pieces: the look back from a node ends where no piece does.
        self.endings: dict[str, float | None] = {}
        for piece, score in scores.items():
            for at in range(1, len(piece)):
                self.endings.setdefault(piece[at:], None)
            self.endings[piece] = score
        self.longest = max(map(len, scores), default=0)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self._clear()

    def _clear(self) -> None:
        # A node is (children, forward score, tokens).
        self.root: tuple[dict, float, int] = ({}, 0.0, 0)
        self.terminal: dict[bytes, int] = {}
        self.nodes = 1

    def _grow(self, word: str, path: list[tuple[dict, float, int]]) -> tuple[dict, float, int]:
        """The node below ``path`` for the prefix of ``word`` one character longer."""
        end, endings = len(path), self.endings
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, count = path[-1][1] + size * self.byte_score, path[-1][2] + size
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in endings:
                break
            score = endings[piece]
            if score is not None:
                total, tokens = path[start][1] + score, path[start][2] + 1
                if total > best or (total == best and tokens < count):
                    best, count = total, tokens
        self.nodes += 1
        return ({}, best, count)

    def _long(self, word: str) -> int:
        """The same forward scores over one pre-token, of which only as many are kept as the longest piece has characters."""
        kept, endings = self.longest + 1, self.endings
        scores, counts = [0.0] * kept, [0] * kept
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, count = scores[(end - 1) % kept] + size * self.byte_score, counts[(end - 1) % kept] + size
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if piece not in endings:
                    break
                score = endings[piece]
                if score is not None:
                    total, tokens = scores[start % kept] + score, counts[start % kept] + 1
                    if total > best or (total == best and tokens < count):
                        best, count = total, tokens
            scores[end % kept], counts[end % kept] = best, count
        self.nodes += len(word) // 64  # the word itself is remembered
        return counts[len(word) % kept]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of one pre-token."""
        if self.nodes > self.max_nodes:
            self._clear()
        if len(word) > LONG_WORD:
            return self._long(word)
        node, path = self.root, [self.root]
        for ch in word:
            below = node[0].get(ch)
            if below is None:
                below = node[0][ch] = self._grow(word, path)
            node = below
            path.append(node)
        return node[2]


def token_counts(docs: DataFrame, vocabulary: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``n_chars``, ``n_pretokens``, ``n_tokens`` of every row of
    ``docs`` (``doc_id``, ``text``).

    Pre-tokens are runs between ASCII white space, each with a leading space
    mark; their distinct forms are inserted into a trie and scored once per
    prefix. Each task fills its own trie, so no text is shuffled. Null and empty
    texts have no tokens; repeated rows are counted each. ``vocabulary`` is a
    file path that executors can read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SegmentTrie(unigram_scores(vocabulary), max_nodes)
        for b in batches:
            chars, pretokens, tokens = [], [], []
            for text in (t for texts in in_slices(b.column("text")) for t in texts):
                parts = text.encode().split()
                for w in set(parts).difference(trie.terminal):
                    n = trie.count(SPACE_MARK + w.decode())
                    trie.terminal[w] = n
                try:
                    total = sum(map(trie.terminal.__getitem__, parts))
                except KeyError:  # the trie was started anew within this text
                    total = sum(trie.count(SPACE_MARK + w.decode()) for w in parts)
                chars.append(len(text))
                pretokens.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in (chars, pretokens, tokens)]],
                                             ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(counted, f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars long, n_pretokens long, n_tokens long")
