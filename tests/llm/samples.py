"""Documents that every operator has to take."""

#: One document of every odd kind: nulls, empty, white space, long, tied, repeated.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two"),
    (5, "Word " * 30_000, None),
    (6, "the same text with some more words in it"),
    (7, "The SAME text with some more words in it"),
    (8, "the same text with some more words in it", "t"),
    (8, "the same text with some more words in it", "t"),
    (None, "nobody knows this document"),
    (None, None, None),
    (9, "été 中文 ñandú 😀 \x00 end\u00a0here 'tis don't I'LL 123abc"),
    (10, "a" * 50_000),
]
