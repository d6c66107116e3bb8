"""Ids and texts that every operator must take: nulls, empty, repeated, odd and very long."""

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "Two words"),
    (7, "Über straße \U0001f600 世界 İDž é ſK"), (8, "a " * 30_000),
    (9, "<|endoftext|> it's 12 ²½ x y z \x1c\x85 end"),
    (None, "no id"), (None, None), (6, "Two words"), (10, "x" * 5_000),
    (11, "Tail\r\n  and   runs\n\n of  space  "), (12, "ŉ œuvre ﬁn <|endoftext|>"),
]
