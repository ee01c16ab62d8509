"""Documents with the awkward cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, size long, t string, fp long, kept string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["an", "er", "th", "ou", "é", "ß", "Ti", "no"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Whole rows for SCHEMA: copies, near copies, nulls, empty and long texts, repeated ids and rows, odd characters."""
    r = random.Random(7)
    passage = sentence(r, 60)
    texts: list[str | None] = [sentence(r, r.choice([1, 3, 30, 80, 200])) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5], None, "", None, "   \n\t ", "one", "a b c", "a b c d"]
    texts += [f"{sentence(r, 30)}\n{passage}\n{sentence(r, 20)}" for _ in range(6)]
    texts += [texts[20] + " more", texts[20].replace(" ", "  "), "the cat sat " * 200, "x" * 5000, sentence(r, 9000)]
    texts += ["Released under the MIT License.", "UNDER the (mit) license, under the MIT license", "cc by nc cc by-nc", "Licensed under the Apache License, Version 2.0. CC BY NC", "apacheé license version 2"]
    texts += ["<|endoftext|> it's I'LL we'd 12½ ²x _a_ b", "a b c d", "\x1cq\x1fr \x85s", "İstanbul Σίσυφος ΣΑΣ K", "日本語 テキスト 😀😀 é ñ", "a  b\n\n c\t\td  ", " lead", "trail ", "###*** $$ %% && | <> !!", "l1\nl1\nl2\n\n\nl1\n  \n  "]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t) if t is not None else None, 1, 2, "t", 3, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[65], (2, "another text with the id two", None, None, None, None, None, None, None, None)]
    rows += [(None, texts[7], "en", "src1", None, None, None, None, None, None), (None, "no id here", "en", "b", None, None, None, None, None, None)]
    return rows
