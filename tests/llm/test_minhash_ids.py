"""One id with several texts is one document that any of them links."""

import random

from spanweave.llm import minhash
from test_minhash import compare, edited


def test_each_text_of_an_id_links(spark):
    rng = random.Random(7)
    bases = [[f"t{g}w{rng.randrange(300)}" for _ in range(150)] for g in range(8)]
    text = lambda g: " ".join(edited(rng, bases[g], 1))
    # document 1 has a text near each of 10 to 14, and so do 2 (two texts) and 3 (one text and none)
    rows = [(1, text(g)) for g in range(5)] + [(10 + g, text(g)) for g in range(5)]
    rows += [(20, text(5)), (20, text(6)), (2, text(6)), (21, text(5)), (30, ""), (30, text(7)), (3, text(7)), (40, "a b c"), (40, "d e f"), (41, "D e f"), (42, "A b c")]
    rng.shuffle(rows)
    compare(spark, rows, 80)


def test_two_texts_in_hubs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(8)
    bases = [[f"t{g}w{rng.randrange(300)}" for _ in range(150)] for g in range(2)]
    rows = [(i % 12, " ".join(edited(rng, bases[i % 2], rng.randrange(3)))) for i in range(40)]
    rows += [(100 + i, " ".join(edited(rng, bases[0], 2))) for i in range(10)] + [(100, "x y z"), (50, "x y z")]
    compare(spark, rows, 80)
