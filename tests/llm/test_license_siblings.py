"""License notices side by side, siblings, denials and identifier lines; spans against a plain alignment."""

import random

import pytest

from geoloom.llm import licenses

KNOWN = licenses.Templates(licenses.templates())


def names(text, least=0.8):
    return sorted({x[0] for x in licenses.scan_text(text.lower().encode(), KNOWN, least)})


@pytest.mark.parametrize("text, found", [
    ("Released under the MIT License and the BSD License.", ["MIT"]),
    ("Released under the MIT License. Released under the BSD License.", ["BSD", "MIT"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", ["Apache-2.0", "BSD-3-Clause", "MIT"]),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nint x;", ["GPL-2.0"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1"]),
    ("SPDX-License-Identifier: GPL-3.0+", ["GPL-3.0"]),
    ("SPDX-License-Identifier: MIT-0", []),
    ("SPDX-License-Identifier: MIT\n2 files", ["MIT"]),
    ("SPDX-License-Identifier: LicenseRef-Own", []),
    ("Released under the MIT-0 License.", []),
    ("This work is licensed under the GNU Library General Public License, version 2.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("not licensed under the MIT License", []),
    ("This is not released under the MIT License.", []),
    ("It is not yet released under the MIT License.", []),
    ("not released under the MIT License.", []),
    ("It is never Released under the MIT License. Released under the ISC License.", ["ISC"]),
    ("Why not. Released under the MIT License.", ["MIT"]),
    ("Licensed under GPL-2.0", ["GPL-2.0"]),
    ("Licensed under LGPL-2.1.", ["LGPL-2.1"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("Released under CC0 1.0.", ["CC0-1.0"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"]),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["Apache-2.0"]),
])
def test_sentences(text, found):
    assert names(text) == found


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(8))
def test_spans_cover_their_templates(seed):
    """Notices with lost words, side by side with others and words that no notice has: each whole one is found, each span
    that is found holds by a plain common subsequence what it says, and spans do not overlap."""
    r = random.Random(seed)
    texts = licenses.templates()
    chosen = r.sample(sorted(texts), 4)
    plain = lambda t: [(m[1] or m[2]) for m in licenses._MARKED.finditer(t.lower().encode())]
    words, places = [], []
    for name in chosen:
        words += [f"w{r.randrange(99)}".encode() for _ in range(r.randrange(3, 40))]
        own = plain(texts[name])
        places.append((name.split(" ")[0], len(words), len(words) + len(own)))
        words += own
    words += [b"w1"] * 3
    got = licenses.scan_text(b" ".join(words), KNOWN, 0.8)
    for name, a, b in places:
        assert any(x[0] == name and x[2] <= a and b <= x[3] or x[2] < b and a < x[3] for x in got)
    assert sorted((x[0], x[2], x[3]) for x in got if x[1] == 1.0) and len(got) >= 4
    for name, coverage, a, b in got:
        best = max(common(words[a:b], own) / len(own) for n, t in texts.items() if n.split(" ")[0] == name for own in [plain(t)])
        assert best >= coverage - 1e-9 >= 0.8 - 1e-9
    spans = sorted((a, b) for _, _, a, b in got)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_a_very_long_text():
    filler = " ".join(f"word{k % 977} the of software license" for k in range(60_000))
    text = f"{filler} Released under the ISC License. {filler} SPDX-License-Identifier: Zlib AND MIT\n{filler}"
    assert names(text) == ["ISC", "MIT", "Zlib"]
