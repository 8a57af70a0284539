"""Small tables with everything that input may hold."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, cls string, n int, seq string"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(n)]


def documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated and near-equal rows, clashing column names."""
    base = words(1, 80)
    near = [*base[:40], "changed", *base[41:]]
    far = [*base[:40], *words(2, 40)]
    texts = [
        " ".join(base), " ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(), None, "", " \n\t ", "one", "one", "one two three",
        "one two three four five", "one two three four five six", "\n".join(["same line"] * 30), " ".join(words(3, 6000)), "x" * 50_000, "日本語 テキスト " * 40,
        "naïve café — “quoted” 😀 text\r\nwith 1234 numbers, it's the ’end", " ".join(base[:60] + words(4, 3)), " ".join(words(5, 300)), " ".join(words(5, 300)[:290]),
    ]
    rows = [(i * 7 % 50, t, ["en", None, "fr"][i % 3], [None, "src0", "src1", "src0"][i % 4], None if i % 5 == 0 else len(t or ""), "clash", i, "c", None, "s") for i, t in enumerate(texts)]
    rows.append((None, "a row without an id " + " ".join(base), None, None, None, None, None, None, None, None))
    rows.append(rows[3])  # a repeated row
    return rows
