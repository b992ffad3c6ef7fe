import random

import public_tokenizers
import sentencepiece
from odd import documents, odd_rows

from gleaner.llm.tokens import MergeTable, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    rng = random.Random(3)
    signs = "abcabc ▁\n\té漢字ß👍the ing.,!<s>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    # pieces that rank above their own parts, runs of one pair, long unbroken strings
    texts += ["a" * 5000, "ab" * 3000, " " * 777, "▁▁ ▁", "", "membres membre's", "</s> <unk>",
              "".join(rng.choice("abcdefghij0123456789") for _ in range(20_000))]
    merges = MergeTable.of_pieces(MODEL)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)]
    assert [int(merges.count(merges.pretokens(t)).sum()) for t in texts] == want


def test_odd_documents(spark):
    rows = token_counts(documents(spark, odd_rows()), MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == sorted(
        (len((t or "").encode()), len(library.encode(t or ""))) for _, t, _ in odd_rows())
    assert [r["doc_id"] for r in rows if r["over_limit"]] == [4]
    assert token_counts(documents(spark, []), MODEL).count() == 0
