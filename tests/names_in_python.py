"""Name similarity in plain Python."""


def plain(a, b, ratio):
    ca, cb = a.replace(" ", ""), b.replace(" ", "")
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if ca == cb:
        return 0.99
    return max(ratio(a, b), 0.9) if ca in cb or cb in ca else ratio(a, b)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))
