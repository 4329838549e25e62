import re

from querylens.llm import secrets


def test_wide_classes_are_not_spelt_out():
    for body in ("[!-~]", "[a-z!-~]", "[!-\\xff]"):
        rule = secrets.Rule("custom", f"key={body}end")
        assert re.search(rule.pattern, "key={end") and "{en" not in secrets.trigrams(secrets.trigram_query(rule))
        query = secrets.trigram_query(rule)
        wanted = sorted(secrets.trigrams(query))
        import numpy as np

        table = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(wanted):
            a, b, c = t.encode("latin-1")
            table[a << 16 | b << 8 | c] = i + 1
        assert list(secrets.SegmentIndex([b"nothing", b"key={end"], table, wanted).candidates(query)) == [1]
    narrow = secrets.trigram_query(secrets.Rule("custom", "key=[0-9]end"))
    assert {"=0e", "9en"} <= secrets.trigrams(narrow)
