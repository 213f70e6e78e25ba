import random

from tilewright.llm import licences as L


def made():
    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)] + ["the", "of", "and", "this", "is", "work", "under"]
    plain = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(3)) for _ in range(200)]
    docs, want = [], {}
    for i, text in enumerate(plain):
        if i % 4 == 0:
            family = rng.choice([f for f in L.NOTICES if f != L.UNKNOWN])
            notice = rng.choice(L.NOTICES[family]).split()
            if len(notice) > 12:
                notice = notice[rng.randrange(3) :]
            text = text + "\n" + " ".join(w.upper() if rng.random() < 0.1 else w for w in notice)
            want[i] = family
        docs.append((i, text))
    return docs, want


def test_held_out_notices_are_found_and_plain_text_is_not(spark):
    docs, want = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hits = L.scan(df, L.train(df)).collect()
    got = {r.doc_id: r for r in hits if r.confirmed}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert sum(got[i].family == f for i, f in want.items() if i in got) >= 0.95 * len(got)
    for r in hits:
        assert docs[r.doc_id][1][r.start : r.end] == r.text


def test_licence_text_of_no_family_is_unknown_or_unconfirmed(spark):
    df = spark.createDataFrame(made()[0], "doc_id long, text string")
    odd = spark.createDataFrame([(1, "You are granted a license to use this software under conditions of the Example Vendor agreement"), (2, "word1 word2")], "doc_id long, text string")
    hits = L.scan(odd, L.train(df)).collect()
    assert not any(r.confirmed for r in hits) and all(r.doc_id == 1 for r in hits)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (None, "a\n\nLicensed under CC BY-NC 4.0.\n", "x"), (4, "long " * 100000, "x")], "doc_id long, text string, family string")
    hits = L.scan(df, L.train(df)).collect()
    assert sorted((str(r.doc_id), r.paragraph, r.family) for r in hits) == [("3", 0, "mit"), ("3", 0, "mit"), ("None", 2, "cc-by-nc")]
    empty = df.where("doc_id > 9")
    assert L.scan(empty, L.train(empty)).count() == 0


def test_licences_of_families_that_are_not_learned_are_unknown(spark):
    df = spark.createDataFrame(made()[0], "doc_id long, text string")
    # The cue words keep sampled notices of such licences out of ordinary text.
    unlearned = [
        "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.",
        "This file is made available under the terms of the Common Public License 1.0 which accompanies this distribution.",
        "SPDX-License-Identifier: Ms-PL",
        "Licensed under the Academic Free License version 3.0.",
    ]
    docs = df.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(unlearned)], "doc_id long, text string"))
    hits = {r.doc_id: r for r in L.scan(docs.where("doc_id >= 1000"), L.train(docs)).collect()}
    assert len(hits) >= 3 and not any(r.confirmed for r in hits.values())
    assert sum(r.family == L.UNKNOWN for r in hits.values()) >= len(hits) - 1


def test_wrapped_notices_are_one_paragraph(spark):
    df = spark.createDataFrame(made()[0], "doc_id long, text string")
    header = "# Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software and associated documentation files (the\n# \"Software\"), to deal in the Software without restriction, including\n# without limitation the rights to use, copy, modify, merge, publish,\n# distribute, sublicense, and/or sell copies of the Software."
    text = "First line.\n\n" + header + "\nword1 word2 word3."
    (hit,) = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), L.train(df)).collect()
    assert (hit.family, hit.confirmed, hit.paragraph, hit.text) == ("mit", True, 2, header) and text[hit.start : hit.end] == header


def test_the_sample_is_of_whole_texts():
    text = "a.\nb c\nd\n\n  \ne?\nf"
    got = [[x for _, _, x in lines] for lines in L.paragraphs(text)]
    assert got == [["a."], ["b c", "d"], ["e?"], ["f"]]
    assert all(text[s : s + len(x)] == x for lines in L.paragraphs(text) for _, s, x in lines)


def test_words_of_notices_are_no_notices(spark):
    """Ordinary sentences that quote a few words of a notice are not confirmed, and mostly not found; other licences are no family's."""
    df = spark.createDataFrame(made()[0], "doc_id long, text string")
    quoting = [
        "Permission to use the gym is granted free of charge to any person over 18.",
        "The hotel is free of charge and provided without warranty of any kind said the clerk.",
        "You may not use this file",
        "The publisher holds the copyright of the song and all rights are reserved by law.",
        "He lost his driving license in May.",
    ]
    others = ["Distributed under the PostgreSQL License.", "Licensed under the WTFPL, version 2."]
    notices = {"Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd", "Released under the MIT License.": "mit", "SPDX-License-Identifier: MIT": "mit"}
    texts = [*quoting, *others, *notices]
    hits = {r.text: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), L.train(df)).collect()}
    assert {t for t, r in hits.items() if r.confirmed} == set(notices) and all(hits[t].family == f for t, f in notices.items())
    assert sum(t in hits for t in quoting) <= 2
    assert all(hits[t].family == L.UNKNOWN for t in others if t in hits)


def test_likeness_needs_both_sides():
    whole = L.NOTICES["mit"][0]
    assert L.likeness(L.words(whole), "mit") == 1
    few = " ".join(L.words(whole)[:9])
    assert L.likeness(L.words(few), "mit") < L.ALIKE or len(L.words(whole)) < 36
