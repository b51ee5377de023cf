"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, label string, features int, size int, root string, part int, bucket int"
EXTRA = ("k", 1, "l", 2, 3, "r", 4, 5)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = words[:60] + ["changed"] + words[61:]
    shared = "\n".join(prose(rng, 14) for _ in range(3))
    return [
        base, base, " ".join(near), " ".join(words[:40]), prose(rng, 300), None, None, "", "   \n\t ", "one", "One two THREE four", "one two three four",
        shared + "\n" + prose(rng, 30), prose(rng, 30) + "\n" + shared, "\n".join(["same line here again"] * 6), "a" * 5000, prose(rng, 40_000),
        "### $$$ %%% <<< >>> | | |\n" * 8, "you are an idiot and a moron!! IDIOT", "中文字符测试" * 300, "can't we'll I'd they've 're <|endoftext|> x", "é́    x\r\ny\x0bz\x0c",
    ]
