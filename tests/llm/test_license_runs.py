"""Licences inside longer texts, against a plain search of all runs of words."""

import random
import re

import pytest

from lapforge.llm import licenses
from lapforge.llm.licenses import LEAST, TEMPLATES, all_templates


def grams(words):
    return list(zip(words, words[1:]))


def split(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def all_runs(text, templates):
    """(line, license, dice) of runs by brute force, for texts of which no line and not the whole is a licence."""
    numbered = [(n, w) for n, line in enumerate(text.split("\n"), start=1) for w in split(line)]
    pairs, picked = grams([w for _, w in numbered]), []
    for name, template in templates.items():
        wanted = grams(split(template))
        longest, known, scored = int(len(wanted) * (2 - LEAST) / LEAST + 1e-9), set(wanted), []
        for a in range(len(pairs)):
            found = set()
            for b in range(a, min(len(pairs), a + longest)):
                found.add(pairs[b])
                dice = 2.0 * len(found & known) / (len(found) + len(known))
                if dice >= LEAST:
                    scored.append((-dice, a, b + 1))
        own = []
        for dice, a, b in sorted(scored):
            if all(b <= x or y <= a for x, y in own):
                own.append((a, b))
                picked.append((-len(set(pairs[a:b]) & known), dice, a, name, b))
    taken, out = [], []
    for _, dice, a, name, b in sorted(picked):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((numbered[a][0], name, -dice))
    return out


def wrapped(text, width, rng):
    words = text.split()
    lines = [" ".join(words[i:i + width]) for i in range(0, len(words), width)]
    return "\n".join(f"{rng.choice(['# ', ' * ', ''])}{line}" for line in lines)


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(n))


def scan(spark, texts):
    rows = licenses.license_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {i: sorted((r.line, r.license, r.dice) for r in rows if r.doc_id == i) for i in range(len(texts))}


def test_wrapped_headers_and_shared_lines(spark):
    rng = random.Random(3)
    long = ["mit", "isc", "apache-2.0-header", "gpl-3.0-header", "bsd-2-clause", "bsd-3-clause", "lgpl-2.1-header", "mpl-2.0-notice", "apache-2.0", "gpl-3.0"]
    texts = [f"{prose(rng, 9)}\n{prose(rng, 8)}\n{wrapped(all_templates()[n], 11, rng)}\n{prose(rng, 6 * len(all_templates()[n].split()))}" for n in long]
    texts.append("Great post. Released under the MIT License. Copyright 2020 Jane Doe, all code included")
    got = scan(spark, texts)
    for i, name in enumerate(long):
        assert [(line, found) for line, found, _ in got[i]] == [(3, name)] and got[i][0][2] > 0.9, name
    assert got[len(long)] == [(1, "mit-notice", 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_runs(spark, seed):
    rng = random.Random(seed)
    short = {n: t for n, t in all_templates().items() if len(t.split()) < 120}
    texts = []
    for _ in range(12):
        parts = []
        for name in rng.choices(sorted(short), k=rng.choice([1, 2, 2, 3])):
            words = [w for w in short[name].split() if rng.random() > rng.choice([0, 0.04, 0.1])]
            parts += [prose(rng, rng.choice([0, 3, 30])), wrapped(" ".join(words), 7, rng)]
        # One line of many words, none of whose licences makes up the whole.
        texts.append(rng.choice([" ", "\n"]).join([*parts, prose(rng, 400)]).replace("\n", rng.choice([" ", "\n"])))
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        units = [licenses.best_template(licenses.bigrams(x), {n: licenses.bigrams(t) for n, t in all_templates().items()}, LEAST) for x in text.split("\n")]
        if not any(units):
            assert got[i] == sorted(all_runs(text, short)), text
    assert any(got.values())


def test_sql_has_the_first_templates_only():
    assert set(TEMPLATES) < set(all_templates()) and "BSD" not in licenses._sql()


def test_a_size_at_the_bound_counts():
    assert licenses.best_template(licenses.bigrams("All rights reserved. End"), {"a": licenses.bigrams(TEMPLATES["all-rights-reserved"])}, 0.8) == (0.8, "a")
