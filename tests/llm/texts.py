"""Small corpora with the cases that operators must handle."""

import random

ALPHABET = ["der", "wald", "the", "Fox", "of", "été", "niño", "Straße", "run", "x1", "and", "in", "lorem", "ipsum", "zeta", "quux", "blue", "and,", "end.", "(so)"]


def sentence(r: random.Random, n: int, words=None) -> list[str]:
    return [r.choice(words or ALPHABET) + (str(r.randint(0, 400)) if r.random() < 0.6 else "") for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """(doc_id, text) rows: families of near copies, exact copies, shared passages, short, empty and null texts."""
    r = random.Random(seed)
    passage, line = sentence(r, 60), sentence(r, 15)
    rows: list[list] = []
    for family in range(6):
        base = sentence(r, 60 + 40 * family)
        for _ in range(3 + 4 * family):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = "edit" + str(r.randint(0, 9999))
            rows.append(copy)
        rows += [base, base]
    for _ in range(25):
        own = sentence(r, r.randint(20, 150))
        at = r.randrange(len(own))
        extra = passage if r.random() < 0.5 else line
        rows.append(own[:at] + extra + own[at:] if r.random() < 0.7 else own)
    rows += [line, line, line + ["x"], ["one"], ["one"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "b", "c", "e"], ["A", "B", "C", "d"]]
    rows += [(w := sentence(r, 14)), w[:13], w[1:], w[:12], sentence(r, 3000)]
    r.shuffle(rows)
    texts: list = [r.choice([" ", "  ", "\n", " \t"]).join(w) for w in rows] + ["", None, "   \n", "é"]
    return list(enumerate(texts))
