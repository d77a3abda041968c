"""Notices and identifier lines as they stand in files, each with its labels and no others."""

import pytest

from corpusmill.llm import licenses

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\")",
    "bsd,bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "eupl": "Licensed under the EUPL, Version 1.2 or – as soon they will be approved by the European Commission – subsequent versions of the EUPL",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "gpl-3": "Code: GPLv3",
    "mpl-2": "# SPDX-License-Identifier: MPL-2.0",
    "bsd-2": "// SPDX-License-Identifier: BSD-2-Clause",
    "": "Permission to enter the premises is hereby granted to any person with a ticket, and no licence is given under any terms.",
}


def weights(idx):
    return {w: 1.0 if len(w) < 4 else 5.0 for w in idx.words}


@pytest.mark.parametrize("labels", NOTICES)
def test_notice(labels):
    idx = licenses.Index()
    n = 60 * "lorem ipsum the of "
    got = idx.scan(f"{n}{NOTICES[labels]} {n}".encode(), weights(idx))
    assert got[5] == labels and got[1] == 0


def test_identifier_lines():
    idx = licenses.Index()
    for label, names in licenses.IDENTIFIERS.items():
        for name in names:
            got = idx.scan(f"/* x */\n# spdx-license-identifier: {name}\nimport y".encode(), weights(idx))
            assert got[5].split(",") == [label] and got[6] == 1.0
    both = idx.scan(b"SPDX-License-Identifier: MIT OR Apache-2.0", weights(idx))
    assert both[5] == "mit"  # of an expression, the identifier that follows the mark


def test_a_key_phrase_without_its_notice_and_a_notice_without_its_key_phrase():
    idx = licenses.Index()
    idf = {w: 1.0 for w in idx.words}
    notice = licenses.TEMPLATES["zlib"][0]
    assert idx.scan(notice.replace("held liable", "liable held").encode(), idf)[5] == ""
    assert idx.scan(b"may be used to endorse or promote products derived from this software", idf)[5] == ""
    # the key phrase stands elsewhere, too far from the part that lines up
    assert idx.scan((" ".join(notice.split()[:14]) + " lorem" * 500 + " " + " ".join(notice.split()[11:])).encode(), idf)[5] == "zlib"
    assert idx.scan((" ".join(notice.split()[:16]) + " lorem" * 500 + " " + " ".join(notice.split()[20:])).encode(), idf)[5] == ""


def test_many_rare_words_in_a_long_text():
    import time

    idx = licenses.Index()
    text = b"free of charge to any person in no event will the authors be held liable permission notice version 2 0 license spdx " * 40_000
    began = time.time()
    assert idx.scan(text, weights(idx))[0] == 40_000 * 22 and time.time() - began < 20
