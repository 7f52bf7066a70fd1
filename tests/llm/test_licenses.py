"""Licences in whole, commented, reflowed and embedded form; versions and variants that must not be mixed up."""

import random
import textwrap

import pytest

from clientscope.llm import licenses as li

LIBRARY = li.Library(li.TEMPLATES, 0.8)
PROSE = "Some words of quite another text that nobody would take for a licence of any kind, in {} short lines. " * 6
MIT = f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{li.MIT_GRANT}\n\n{li.MIT_NOTICE}\n\n{li.AS_IS}\n"
BSD3 = f"Copyright 2019 The Authors\n\n{li.BSD_GRANT}\n{li.BSD_NAMES}\n\n{li.BSD_AS_IS}\n"
BSD2 = f"Copyright 2019 The Authors\n\n{li.BSD_GRANT}\n\n{li.BSD_AS_IS}\n"
REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
TEXTS = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": f"Copyright (c) 4-digit year, owner\n\n{li.ISC[0]}\n\n{li.ISC[1]}",
    "Apache-2.0": f"Copyright [yyyy] [name of copyright owner]\n\n{li.APACHE_HEAD}\n\n{li.APACHE_AS_IS}",
    "GPL-2.0": f"{li.gnu('General Public License', '2')}\n\n{REST}", "GPL-3.0": f"{li.gnu('General Public License', '3')}\n\n{REST}",
    "LGPL-2.1": f"{li.gnu('Lesser General Public License', '2.1')}\n\n{REST}", "LGPL-3.0": f"{li.gnu('Lesser General Public License', '3')}\n\n{REST}",
    "AGPL-3.0": f"{li.gnu('Affero General Public License', '3')}\n\n{REST}",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}


def names(text):
    return {license_ for license_, _, _ in LIBRARY.matches(text.encode())}


@pytest.mark.parametrize("license_", sorted(TEXTS))
def test_whole_texts_in_all_forms(license_):
    text = TEXTS[license_]
    assert names(text) == {license_}
    assert names("\n".join(f" * {line}" for line in textwrap.wrap(text, 60))) == {license_}
    assert names("\n".join(f"# {line}" for line in textwrap.wrap(text, 41))) == {license_}
    assert names(PROSE.replace("{}", "2") + " ".join(text.split()) + PROSE.replace("{}", "3")) == {license_}
    assert names(text.upper()) == {license_}


def test_parts_titles_and_mentions():
    assert names(f"MIT License\n\n{li.MIT_GRANT}") == names("The MIT License (MIT)") == {"MIT"}
    assert names("README. This project is licensed under the MIT License. Thanks!") == {"MIT"}
    assert names("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"} and names("Licensed under CC BY 4.0.") == {"CC-BY-4.0"}
    assert names("Mozilla Public License, v. 2.0") == set() and names("a permission to speak") == set()
    assert names(MIT + "\n" + TEXTS["GPL-2.0"]) == {"MIT", "GPL-2.0"}
    assert names(li.gnu("General Public License", "2").replace("version 2", "version 2.0")) == {"GPL-2.0"}


def test_prose_has_no_licence():
    rng = random.Random(1)
    vocabulary = sorted({w.decode() for w in LIBRARY.of_word})
    assert all(names(" ".join(rng.choice(vocabulary) for _ in range(400))) == set() for _ in range(30))
    assert names(PROSE.replace("{}", "1") * 30) == set()


def brute(text, threshold=0.8):
    out, words = {}, li.words_of(text.encode())
    for license_, texts in li.TEMPLATES.items():
        for number, t in enumerate(texts):
            tw = li.words_of(t.encode())
            grams, width = li.bigrams(tw), len(tw)
            for a in range(max(1, len(words) - width + 1)):
                window = words[a : a + width]
                made = li.bigrams(window)
                same = {w for w in window if w.decode() in li.VARIANTS} == {w for w in tw if w.decode() in li.VARIANTS}
                dice = 2 * len(made & grams) / (len(made) + len(grams)) if made else 0
                if dice >= threshold and same and (window[:2] and tuple(window[:2]) in grams or a == max(0, len(words) - width)):
                    out[license_, number] = max(dice, out.get((license_, number), 0.0))
    return out


def test_matches_all_windows():
    rng = random.Random(2)
    for _ in range(60):
        license_ = rng.choice(sorted(TEXTS))
        words = TEXTS[license_].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 8)):
            words[rng.randrange(len(words))] = rng.choice(["other", "version", "2", "the"])
        text = " ".join(["lead"] * rng.randrange(4) + words + ["tail"] * rng.randrange(4))
        made = {(k, i): d for k, i, d in LIBRARY.matches(text.encode())}
        want = brute(text)
        assert all(made.get(k, 0) <= d + 1e-12 for k, d in want.items()) and all(want.get(k) == pytest.approx(d) for k, d in made.items())
        assert {k for k in made} <= set(want)


def test_frames(spark):
    rows = [(1, MIT), (1, MIT), (2, None), (3, ""), (None, BSD3), (4, "word"), (5, "x " * 50_000 + MIT)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = sorted(((r.doc_id or 0, sorted({m.license for m in r.licenses})) for r in li.scan_licenses(frame).collect()))
    assert made == [(0, ["BSD-3-Clause"]), (1, ["MIT"]), (1, ["MIT"]), (2, []), (3, []), (4, []), (5, ["MIT"])]
    with pytest.raises(ValueError):
        li.Library({"x": ["word"]}, 0.8)
