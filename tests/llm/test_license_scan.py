import re
from collections import Counter

import duckdb
import edge
import pytest

from mkpulse.llm import license_scan as S
from mkpulse.llm import queries

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
       ' (the "Software"), to deal in the Software without restriction')
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
       " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
       " software without specific prior written permission.")
GPL = ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"
       " either version 3")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(S.WORD, lowered(text))


def brute(rows, templates=S.TEMPLATES, phrases=S.PHRASES, rare=S.RARE, slack=S.SLACK):
    texts = [words(t) for _, t in rows]
    counts = Counter(w for t in texts for w in set(t))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        base = sorted((at, label) for p, label in phrases.items() for at in S.places(w, p.split()))
        own, score = set(), 0.0
        for t in templates:
            tw = t.text.split()
            seldom = sorted(set(tw), key=lambda x: (counts[x], x))[:rare]
            at = [(p, x) for p, x in enumerate(tw) if x in seldom]
            for o in range(-len(tw), len(w)):
                n = sum(0 <= o + p < len(w) and w[o + p] == x for p, x in at)
                near = all(any(b + d >= 0 and w[b + d : b + d + len(k.split())] == k.split() for d in range(-slack, slack + 1))
                           for k in t.keys for b in [o + S.places(tw, k.split())[0]])
                if n and 2 * n >= len(at) and near:
                    own.add(t.label)
                    score = max(score, n / len(at))
        labels = {x for _, x in base}
        out.append((i, len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted(labels)), ",".join(sorted(labels | own)), score))
    return sorted(out, key=repr)


def run(frame, **how):
    found = S.verdicts(S.scan(frame, **how), how.get("phrases"))
    return sorted((tuple([r.row["doc_id"], *r[1:]]) for r in found.collect()), key=repr)


ROWS = [
    (1, MIT), (2, "x " * 50 + BSD + " tail"), (3, GPL), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under the Apache License, Version 2.0."),
    (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Released under the MIT License.\n" * 300), (8, None), (9, ""),
    (10, "ALL RIGHTS RESERVED. cc-by, Cc By: all rights\nreserved"), (11, "the mit is a school and the license of a driver was released"),
    (12, "Permission is hereby granted, free of charge, to Ann and Bob of the old town only, to deal in the Software without restriction"),
    (13, "Permission by Acme is hereby granted free of charge to any person obtaining a copy of this software and associated files"), (14, "\x00cc\x00by\x7f ſ É"),
    (15, "licensed under the apache licence version 2 0"), (16, GPL.replace("General", "Lesser General")), (16, GPL.replace("General", "Lesser General")),
    (None, "This is free and unencumbered software released into the public domain."), (17, "general general public license public license"),
    (18, "cc by cc by cc"), (20, "// SPDX-License-Identifier: Apache-2.0"), (21, "SPDX-License-Identifier: GPL-3.0-only"), (22, "spdx identifier of a licence: mit"), (19, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def test_matches_brute_force(spark):
    got = run(edge.clashing(spark.createDataFrame(ROWS, "doc_id long, text string")).repartition(3))
    assert got == brute(ROWS)
    labels = {r[0]: r[6] for r in got}
    assert labels[1] == "mit" and labels[2] == "bsd,bsd-3-clause" and labels[3] == "gpl" and labels[4] == "cc-by,cc-by-nc-4.0"
    assert labels[5] == "apache-2.0" and labels[6] == "gpl,gpl-3.0" and labels[7] == "mit" and labels[10] == "cc-by,reserved"
    assert labels[11] == labels[12] == labels[15] == "" and labels[None] == "unlicense" and labels[16] == "gpl,lgpl" and labels[19] == "cc-by-nc"
    assert labels[20] == "apache-2.0" and labels[21] == "gpl-3.0" and labels[22] == ""


def test_edge_documents_and_empty_table(spark):
    docs = edge.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute([r for r in rows])
    assert run(docs.limit(0)) == []


def test_other_templates_and_none(spark):
    mine = (S.Template("house", "for use inside the house only do not pass on", ("inside the house only",)),)
    rows = [(1, "For use, inside the house only; do not pass on!"), (2, "inside the house only"), (3, "for use inside the barn only do not pass on")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    how = {"templates": mine, "phrases": {"pass on": "passing"}, "rare": 3, "slack": 2}
    assert run(frame, **how) == brute(rows, **how)
    assert run(frame, templates=(), phrases={}) == brute(rows, (), {})
    with pytest.raises(ValueError, match="mandatory"):
        S.scan(frame, (S.Template("x", "a b", ("c",)),))


def test_sql_agrees_on_planted_notices(spark, scratch):
    path = f"{scratch}/documents.parquet"
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted((tuple(r) for r in queries.QUERIES["op12_license_index"](spark, scratch).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE["op12_license_index"]).fetchall(), key=repr) == brute(ROWS)


def test_plan_has_no_python_and_no_join(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = S.verdicts(S.scan(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Exchange", plan)
