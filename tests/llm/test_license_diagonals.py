import re

from dawnchorus.llm.license_diagonals import LICENSES, PHRASES, scan_licenses
from tests.llm.helpers import docs, with_clashes

MIT = LICENSES[0].text


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, p.label) for p in PHRASES for i in range(len(words))
              if words[i:i + len(p.text.split())] == p.text.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


TEXTS = {
    1: "Released Under the MIT License.", 2: None, 3: "", 4: "cc by", 5: "CC-BY-NC cc by nc",
    6: "the apache license, version 2.0 under the mit license under the mit license",
    7: "x " * 60000 + "cc by nc " * 300, 8: "under the mit licenſe", 9: "Ünder the mit license Under the mit license",
    10: "under\x00the\x7fmit\nlicense", 11: "cc by cc by nc by nc", 12: "under the mıt license",
    13: "\u212anow under the mit license",
}


def test_phrases_against_brute_force(spark):
    rows = [*TEXTS.items(), (6, TEXTS[6]), (None, "cc by nc")]
    got = scan_licenses(with_clashes(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by nc" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates_with_edits(spark):
    words = MIT.split()
    edited = words[:10] + ["indeed", "so"] + words[10:18] + words[19:]
    rows = [(1, "Intro. " + MIT.capitalize() + " Outro"), (2, " ".join(edited)), (3, " ".join(words[:8])),
            (4, " ".join(reversed(words))), (5, "This work is licensed under the GNU General Public License, version 3."),
            (6, "plain words that name no license of any kind at all")]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, rows)).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[1].base_labels == ""
    assert got[2].labels == "mit" and 0.7 <= got[2].score < 1
    assert got[3].labels == "" and 0 < got[3].score < 0.7
    assert got[4].labels == "" and got[5].labels == "gpl" and got[6].labels == "" and got[6].score == 0
    span = got[1].spans[0]
    assert (span.label, span.start) == ("mit", 1)


def test_every_notice_gets_its_own_label_alone(spark):
    """Also inside other text, with a word put in, and two notices one after the other."""
    texts = [(i, f"Copyright 2020 the authors. {t.text.capitalize()}. More words follow here.") for i, t in enumerate(LICENSES)]
    n = len(texts)
    pairs = [(i, (i + 7) % n) for i in range(n)]
    texts += [(n + i, f"{LICENSES[a].text}\n\n{LICENSES[b].text}") for i, (a, b) in enumerate(pairs)]
    got = {r.doc_id: r.labels for r in scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(LICENSES):
        assert got[i] == t.label
    for i, (a, b) in enumerate(pairs):
        assert got[n + i] == ",".join(sorted({LICENSES[a].label, LICENSES[b].label}))


def test_kin_notices(spark):
    notice = "This work is licensed under a Creative Commons {} International License."
    rows = {1: notice.format("Attribution 4.0"), 2: notice.format("Attribution-NonCommercial-ShareAlike 4.0"),
            3: notice.format("Attribution-NoDerivatives 4.0"),
            4: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
               "Public License as published by the Free Software Foundation",
            5: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            6: (notice.format("Attribution 4.0") + " ") * 2000 + notice.format("Attribution-ShareAlike 4.0")}
    got = {r.doc_id: r.labels for r in scan_licenses(docs(spark, list(rows.items()))).collect()}
    assert got == {1: "cc-by", 2: "cc-by-nc-sa", 3: "cc-by-nd", 4: "lgpl", 5: "mpl-2", 6: "cc-by,cc-by-sa"}


def test_empty_table(spark):
    assert scan_licenses(docs(spark, [])).collect() == []
