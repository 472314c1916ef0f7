"""Rows (doc_id, text, lang, source) with what operators must stand."""

TEXTS = [
    (1, "The cat sat on the mat, don't 12ab!?..\r\n foo\tbar  ", "en", "s1"),
    (2, "The cat sat on the mat, don't 12ab!?..\r\n foo\tbar  ", "en", "s1"),
    (3, "", "en", "s1"),
    (4, None, None, None),
    (5, "a<|endoftext|>b \n\n  C's \x1c\x1d x　y  ½ⅷ naïveЖabc é́x ​ 中文字 😀😀a œuvre “q” – ²³", "fr", "s2"),
    (None, "X İ straße", "de", None),
    (7, " \t\n\x0b\f\r ", "de", "s2"),
    (8, "x y z " * 4000, "de", "s2"),
    (9, "w" * 5000 + " tail", "en", "s2"),
    (9, "w" * 5000 + " tail", "en", "s2"),
]
