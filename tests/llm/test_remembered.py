"""The encoder's memory of words changes how often a word is worked out, never its tokens."""

import random

from querylens.llm import bpe, packing


def test_words_that_fit_the_memory_are_worked_out_once():
    rng, made = random.Random(3), {}
    words = sorted({"".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=7)) for _ in range(6000)})
    text = " ".join(["x", *words])
    for size in (1 << 17, 1 << 23):
        encoder, met = bpe.Bpe(bpe.tokenizer_path(), size), []
        encoder.tokens = lambda s, met=met, work=encoder.tokens: met.append(s) or work(s)
        made[size] = encoder.encode(text), encoder.encode(text), len(met)
    small, large = made.values()
    assert small[:2] == large[:2] and small[0] == small[1]
    assert small[2] == 2 * len(words) + 2 and large[2] == len(words) + 2  # and x, and the line feed


def test_packing_alone_remembers_more_and_packs_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert packing.REMEMBERED_ALONE > bpe.REMEMBERED_BYTES
    one, other = (sorted(tuple(r) for r in packing.pack(docs, remembered=n).collect()) for n in (1 << 16, packing.REMEMBERED_ALONE))
    assert one == other
