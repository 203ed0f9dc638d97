import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm import sentencepiece_codec as codec
from changeloom.llm import token_counts
from changeloom.llm.pieces import DEFAULT_MODEL, MARKER, DoubleArray, Segmenter, Vocabulary

ODD = [" a", "a  b ", "▁x▁ y", "\n\n a\tb", "日本語テスト 🎉🎉", "", "\x00\x01", "é" * 300 + " " + "x" * 5000, "   ", "a\r\nb", None]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def trie(vocabulary):
    return DoubleArray.build(vocabulary.pieces)


def test_trie_holds_the_pieces(vocabulary, trie):
    for piece, i in list(vocabulary.pieces.items())[::7]:
        state = 0
        for b in piece.encode():
            to = trie.base[state] + b + 1
            assert trie.check[to] == state
            state = to
        assert trie.value[state] == i


def test_small_vocabulary_against_all_segmentations(vocabulary):
    scores = np.zeros(300)
    pieces = {"a": 256, "b": 257, "ab": 258, "ba": 259, "aab": 260, MARKER: 261, MARKER + "a": 262, "bb": 263}
    scores[256:264] = [-1, -2, -3, -2, -4, -1, -2.5, -3.5]
    strings = [bytes([i]) for i in range(256)] + [p.replace(MARKER, " ").encode() for p in pieces]
    small = Vocabulary.of(pieces, strings, scores, np.arange(256, dtype=np.int32))
    segmenter, counter = Segmenter(small, DoubleArray.build(pieces)), token_counts.Counter(small)

    def best(word):
        found = [(0.0, ())]
        table = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            for start in range(end):  # starts in order, strictly better replaces: the tie rule
                if (i := pieces.get(word[start:end])) is not None and start in table:
                    total = table[start][0] + scores[i]
                    if end not in table or total > table[end][0]:
                        table[end] = (total, (*table[start][1], i))
        return found and table[len(word)]

    words = [MARKER + "".join("ab"[(n >> k) & 1] for k in range(length)) for length in range(1, 8) for n in range(2**length)]
    together = segmenter.many([w.encode() for w in words])
    for word, ids in zip(words, together, strict=True):
        assert tuple(ids) == best(word)[1] == tuple(segmenter.one(word.encode()))
        assert counter.count(word) == (len(ids), 0, best(word)[0])


def test_against_the_library(vocabulary, trie, small):
    """The library's unigram encoder, with the scores of its unreachable space runs raised, so that its 32-bit sums stay exact."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -50_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for r in small.limit(60).collect() for w in r.text.split()})
    ours = Segmenter(vocabulary, trie).many([(MARKER + w).encode() for w in words])
    assert len(words) > 2000 and ours == [library.encode(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_round_trip(vocabulary, trie, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = codec.Encoder(vocabulary, trie).encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [codec.decode(ids[at[i] : at[i + 1]].tolist(), vocabulary.strings) for i in range(len(texts))] == texts
    counter, find = token_counts.Counter(vocabulary), vocabulary.segments().findall
    assert [sum(counter.count(w.replace(" ", MARKER))[0] if w != MARKER else 3 for w in find(" " + t)) if t else 0 for t in texts] == counts.tolist()


def test_operators_agree_on_odd_texts(make_docs):
    docs = make_docs(list(enumerate(ODD)) + [(3, ODD[3]), (None, "null id")], ("ids", "decoded", "n_tokens"))
    decoded = codec.decode_ids(codec.encode_texts(docs)).collect()
    assert len(decoded) == len(ODD) + 2 and all(r.decoded == r.text and (r.text is None) == (r.ids is None) for r in decoded)
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert all(counts[r.doc_id] == r.n_pieces for r in decoded)
    assert codec.encode_texts(make_docs([])).count() == 0 and token_counts.count_tokens(make_docs([])).count() == 0


def test_remembered_words_are_bounded(vocabulary, trie, monkeypatch):
    monkeypatch.setattr(codec, "REMEMBERED", 3)
    encoder = codec.Encoder(vocabulary, trie)
    for text in ("one two three four five", "six seven eight", "one two"):
        ids, _ = encoder.encode([text])
        assert codec.decode(ids.tolist(), vocabulary.strings) == text
    assert len(encoder.codes) <= 3 + 2  # the bound, and what one batch adds


def test_operators_on_the_tables(small):
    decoded = codec.decode_ids(codec.encode_texts(small.select("doc_id", "text")))
    assert decoded.where("NOT decoded <=> text").count() == 0
    counts = token_counts.count_tokens(small)
    assert decoded.join(counts, "doc_id").where("n_pieces <> n_tokens OR n_byte_pieces <> n_byte_tokens").count() == 0
