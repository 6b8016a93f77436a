"""Secrets behind names and paths, clean strings that only look random, licence expressions in whole texts, and near copies among documents that share an id."""

import random

import pytest

from landloom.llm import licenses, secrets, simhash

HEXES, LETTERS = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WORDS = "docs guide chapter section forest river window account profile service handler manager report user request index static images button header footer release branch feature update install public assets module package number letter mountain garden summer winter history science kernel driver buffer stream".split()


def keys(rnd, n=300):
    """Random keys and where they stand: alone, behind a name, in a path, assigned to an unknown name."""
    for k in range(n):
        key = "".join(rnd.choice(HEXES) for _ in range(rnd.choice([32, 40, 64]))) if k % 3 == 0 else "".join(rnd.choice(LETTERS) for _ in range(rnd.choice([24, 32, 40]))) if k % 3 == 1 else "".join(rnd.choice(LETTERS + "+/") for _ in range(40))
        yield key, [key, f"deploy_key_{key}", f"api/v1/keys/{key}", f"release-{key}", f"CREDENTIAL={key}"][k % 5]


def test_keys_are_found_wherever_they_stand():
    rnd = random.Random(1)
    found = whole = left = 0
    for key, text in keys(rnd):
        clean = secrets.redact(f"see {text} there")
        found += "[SECRET]" in clean
        whole += key not in clean and not any(key[i : i + 12] in clean for i in range(len(key) - 11))
        left += any(w in clean for w in ("deploy_key_", "api/v1/keys/", "release-", "see ")) and clean.endswith(" there")
    assert found >= 0.97 * 300 and whole >= 0.93 * 300 and left == 300
    assert secrets.redact("use deploy_key_9F86D081884C7D659A2FEAA0C55AD015 now") == "use deploy_key_[SECRET] now"


def test_clean_strings_stay():
    rnd = random.Random(2)
    word = lambda: rnd.choice(WORDS)
    makes = [
        lambda: "/".join(word() + str(rnd.randrange(20)) * (rnd.random() < 0.6) for _ in range(5)),
        lambda: "-".join(word() for _ in range(6)),
        lambda: "".join(word().title() for _ in range(6)),
        lambda: word() + "".join(word().title() for _ in range(5)) + str(rnd.randrange(10)),
        lambda: "_".join(word().upper() for _ in range(5)),
        lambda: f"{word()}-{word()}-{rnd.randrange(10)}-{rnd.randrange(99)}-{rnd.randrange(9999)}-{word()}",
        lambda: f"{rnd.randrange(1990, 2030)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}_{rnd.randrange(24):02}-{rnd.randrange(60):02}-{rnd.randrange(60):02}_{word()}",
        lambda: f"{word()}/{word()}/{rnd.randrange(2000, 2030)}/{rnd.randrange(1, 13):02}/{word()}_{word()}{rnd.randrange(100)}",
    ]
    wrong = [t for k in range(1600) if secrets.find(f"see {(t := makes[k % 8]())} there")]
    assert len(wrong) <= 16, wrong[:5]
    for t in ("docs/guide12/chapter7/section3/forest1234", "123e4567-e89b-12d3-a456-426614174000", "AbstractSingletonProxyFactoryBean", "2024-01-02-2024-01-02-03", "=" * 80, "-" * 40 + "/" * 30):
        assert secrets.redact(f"see {t} there") == f"see {t} there"


@pytest.mark.parametrize(
    "text, score, labels",
    [
        ("SPDX-License-Identifier: MIT OR GPL-2.0-only", 0.9, {"mit", "gpl-2.0"}),
        ("// SPDX-License-Identifier: MIT OR MPL-2.0\nint x;", 0.9, {"mit", "mpl-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", 0.7, {"gpl-2.0"}),
        ("SPDX-License-Identifier: MIT AND GPL-3.0-only", 0.4, {"mit", "gpl-3.0"}),
        ("SPDX-License-Identifier: (MIT OR CC-BY-4.0)\nmore", 0.9, {"mit", "cc-by"}),
        ("All rights reserved.\nSPDX-License-Identifier: MIT", 0.05, {"mit", "reserved"}),
        ("SPDX-License-Identifier: MIT OR MPL-2.0\n\nlater: under the Mozilla Public License 2.0", 0.6, {"mit", "mpl-2.0"}),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", 0.85, {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: (MIT OR\nmpl 2.0", 0.6, {"mpl-2.0"}),
        ("Licensed under the EUPL", 0.5, {"eupl-1.2"}),
        ("This file is proprietary and confidential", 0.02, {"proprietary"}),
        ("nothing here", 0.0, set()),
    ],
)
def test_an_expression_decides_for_what_stands_in_it(text, score, labels):
    found = licenses.look(text.encode())
    assert (found.score, found.labels) == (pytest.approx(score), labels)


def test_base_places_in_expressions_stay():
    found = licenses.look(b"a SPDX-License-Identifier: MIT OR CC-BY-4.0")
    assert found.base == [(6, "cc-by")] and found.score == pytest.approx(0.9)


def test_near_copies_of_texts_that_share_an_id(spark):
    """Documents 1 (twice, with different texts), 2, a near copy of the second text, 3, of the first, and 4, of none: whatever the order, 2 and 3 go."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(60)) for _ in range(3)]
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, texts[0]), (1, texts[1]), (2, near(texts[1])), (3, near(texts[0])), (4, texts[2]), (2, near(texts[1])), (5, texts[1])]
    for k in range(3):
        rnd.shuffle(rows)
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 2 * k)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (4, texts[2])])
