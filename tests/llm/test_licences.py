"""op8: wording that recurs in a licence, whole texts."""

import random

from logloom.llm import licences
from logloom.llm.base import LOWER_ALNUM, words


def test_recurring_wording_does_not_split_a_cover():
    part = "you may copy it and you may sell it and you may change it"
    template = f"{part} freely {part} always {part} everywhere"
    scanner = licences.Scanner({"x": [template]}, {"all rights reserved": "reserved"})
    share, ranges = scanner.scan(f"before {template} after")["found"]["x"]
    n = len(template.split())
    assert share == 1.0 and ranges[0][0] == 1 and ranges[-1][1] == n + 1
    # changed words between stretches of which each stands at several places of the template
    changed = template.replace("freely", "FREE of charge").replace("always", "now")
    share, ranges = scanner.scan(changed)["found"]["x"]
    assert share > 0.9 and ranges[-1][1] == len(changed.split())


def test_automaton_knows_all_places():
    rng = random.Random(3)
    texts = [[rng.choice("ab").encode() for _ in range(rng.randint(1, 12))] for _ in range(3)]
    auto = licences.Automaton(texts)
    for _ in range(100):
        w = [rng.choice("abc").encode() for _ in range(12)]
        for a, b, ends in auto.stretches(w, 0, 12, 1):
            want = {k: [i + b - a - 1 for i in range(len(t)) if t[i : i + b - a] == w[a:b]] for k, t in enumerate(texts)}
            assert ends == {k: v for k, v in want.items() if v}


def test_whole_texts_with_their_disclaimers():
    scanner = licences.Scanner()
    for label in ("mit", "bsd", "isc", "unlicense"):
        text = licences.TEMPLATES[label][0]
        assert len(words(text, LOWER_ALNUM)) > 100
        share, ranges = scanner.scan(f"Copyright (c) 2001 Somebody\n\n{text}\n")["found"][label]
        assert share == 1.0 and ranges
    text = "é é " + licences.TEMPLATES["mit"][0]
    (a, b), *_ = licences.spans(text, [(2, 6)])
    assert text[a:b] == "Permission is hereby granted"
