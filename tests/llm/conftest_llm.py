"""Texts that every operator must bear."""

#: Null, empty, white space, one word, line breaks, repeats, other scripts, very long.
ODD = [None, "", " \t\n\x0b\x0c\r ", "word", "word", "a\n\nb\n", "é ß 漢字 \U0001f600 \x85\xa0\x1c", "the same words again " * 30, "x" * 5000, " ".join(f"w{i}" for i in range(3000)), "a\r\nb"]
