"""Labelled lines for the personal-data model, made by rule from a seed.

A line is filler with one to three things in it: personal data in forms usual in running text
(plain, spaced, bracketed, spelled out), or things that only look like it (dates, prices, order
numbers, versions, serials, scores). Nothing is taken from a corpus.
"""

from __future__ import annotations

import random

# Cue words before personal data, and before numbers that are something else.
CUES = {
    "email": ["email", "mail", "e-mail", "write", "contact", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "addr", "gateway"],
    "card": ["card", "visa", "credit", "karte", "carte", "tarjeta", "payment"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "ring"],
}
OTHER_CUES = ["order", "isbn", "version", "invoice", "ref", "id", "item", "serial", "page",
              "pages", "lot", "code", "number", "no", "nr", "ticket", "iban", "score", "result"]
FILLERS = ("the and of to in that was for on with as at by from she he they said when over new old"
           " der die das und nicht mit auf von ist el la los que en con una para le les des est dans"
           " pour une sur water market river letter evening window station garden winter story"
           ).split()
NAMES = ("anna bruno carla dmitri elena farid greta hugo ines jonas katya liam marta nils olga pavel"
         " rosa stefan tara umar vera walid").split()
HOSTS = "example sample mailbox postnet webhome inbox company studio office school".split()
ENDINGS = "com org net de fr es io edu info".split()


def digits(rng: random.Random, n: int, first: str = "123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def luhn_ok(number: str) -> bool:
    """Whether the digits of ``number`` pass the check-digit rule of payment cards."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def card_number(rng: random.Random, n: int) -> str:
    body = digits(rng, n - 1, "3456")
    return next(body + c for c in "0123456789" if luhn_ok(body + c))


def grouped(number: str, sizes: list[int], sep: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(number[at:at + n])
        at += n
    return sep.join(p for p in [*parts, number[at:]] if p)


def personal(rng: random.Random) -> tuple[str, str, bool]:
    """(kind, text, whether a cue word must stand before it)."""
    kind = rng.choice(["email", "email", "ip", "card", "phone", "phone"])
    if kind == "email":
        local = rng.choice(NAMES) + rng.choice(["", ".", "_", "-", ""]) + rng.choice(
            ["", *NAMES]) + rng.choice(["", "", digits(rng, 2)])
        host = rng.choice(HOSTS) + rng.choice(["", digits(rng, 1)])
        labels = [*([rng.choice(HOSTS)] if rng.random() < 0.3 else []), host, rng.choice(ENDINGS)]
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "),
                              ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "),
                              (" at ", " dot "), (" AT ", " DOT "), ("{at}", ".")])
        return kind, local.strip("._-") + at + dot.join(labels), False
    if kind == "ip":
        sep, cue = rng.choice([(".", False), ("[.]", False), ("(.)", False), (" . ", True)])
        return kind, sep.join(str(rng.randint(1, 255)) for _ in range(4)), cue
    if kind == "card":
        if rng.random() < 0.25:
            number = card_number(rng, 15)
            return kind, grouped(number, [4, 6, 5], rng.choice([" ", "-", "."])), True
        sep = rng.choice(["", " ", "-", ".", "/", " - ", "_"])
        return kind, grouped(card_number(rng, 16), [4, 4, 4, 4], sep), False
    area, near, last = digits(rng, 3, "23456789"), digits(rng, 3, "23456789"), digits(rng, 4)
    shape = rng.randrange(7)
    if shape == 0:
        return kind, f"+{digits(rng, rng.choice([1, 2]))} ({area}) {near}-{last}", False
    if shape == 1:
        return kind, f"({area}) {near}-{last}", False
    if shape == 2:
        return kind, f"{area}-{near}-{last}", False
    if shape == 3:
        return kind, f"{area}.{near}.{last}", False
    if shape == 4:
        return kind, f"{area} {near} {last}", True
    if shape == 5:
        return kind, f"0{area}{rng.choice(['/', ' ', '-'])}{digits(rng, 7)}", True
    return kind, f"00{digits(rng, 2)} {area} {digits(rng, 7)}", True


def look_alike(rng: random.Random) -> str:
    """A thing with digits or an at-sign that is no personal data."""
    year = str(rng.randint(1900, 2030))
    day, month = f"{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}"
    while True:
        bad = digits(rng, 16)
        if not luhn_ok(bad):
            break
    kinds = [
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}",
        f"{year}-{month}-{day} {day}:{month}:{day}", f"{year}{month}{day}",
        f"{year} {int(year) + 1} {int(year) + 2}", f"{year}-{int(year) + 9}",
        f"{day}.{month}.{year} - {day}.{month}.{int(year) + 1}",
        f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}",
        f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}",
        f"{rng.randint(1, 99)},{digits(rng, 3)},{digits(rng, 3)}.{digits(rng, 2)}",
        f"{rng.randint(1, 99)} {digits(rng, 3)} {digits(rng, 3)}",
        f"{rng.randint(1, 99)}.{digits(rng, 3)}.{digits(rng, 3)}",
        f"${digits(rng, 7)}", f"#{digits(rng, 9)}", digits(rng, rng.choice([7, 8, 9, 10, 11, 12])),
        bad, grouped(bad, [4, 4, 4, 4], rng.choice([" ", "-", "."])),
        digits(rng, rng.choice([13, 14, 17, 18, 19, 22])),
        f"{rng.randint(10, 89)}.{digits(rng, 5)}, {rng.randint(1, 99)}.{digits(rng, 5)}",
        f"978-{digits(rng, 1)}-{digits(rng, 2)}-{digits(rng, 6)}-{digits(rng, 1)}",
        f"DE{digits(rng, 2)} {grouped(digits(rng, 18), [4, 4, 4, 4, 2], ' ')}",
        f"{rng.randint(10, 30)}-{rng.randint(10, 30)} {rng.randint(10, 30)}-{rng.randint(10, 30)}",
        f"{digits(rng, 3)}-{digits(rng, 3)}, {digits(rng, 3)}-{digits(rng, 3)}",
        f"{digits(rng, 4)} {digits(rng, 4)}", f"{digits(rng, 6)}-{digits(rng, 6)}",
        f"{rng.random():.4f} {rng.random():.4f} {rng.random():.4f}",
        f"x{digits(rng, 4)}-{digits(rng, 4)}-{digits(rng, 3)}y",
        "".join(rng.choice("0123456789abcdef") for _ in range(25)),
        f"@{rng.choice(NAMES)}", f"{rng.choice(NAMES)}@{rng.choice(HOSTS)}",
        f"{rng.choice(FILLERS)} at {rng.choice(HOSTS)} dot", f"look at {rng.choice(NAMES)}",
        f"{digits(rng, 3)} @ {digits(rng, 2)}.{digits(rng, 2)}",
        f"({digits(rng, 3)}) {digits(rng, 2)}", f"{digits(rng, 1)} + ({digits(rng, 3)}) {digits(rng, 2)}",
    ]
    return rng.choice(kinds)


def labelled_line(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text and its spans (kind, start, end)."""
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(rng.choice(FILLERS) for _ in range(rng.randint(1, 6))) + " "
        if rng.random() < 0.5:
            kind, shown, cue = personal(rng)
            if cue or rng.random() < 0.4:
                text += rng.choice(CUES[kind]) + rng.choice([" ", ": ", " is ", ". "])
            spans.append((kind, len(text), len(text) + len(shown)))
        else:
            shown = look_alike(rng)
            if rng.random() < 0.4:
                text += rng.choice(OTHER_CUES) + rng.choice([" ", ": ", " no. "])
        text += shown + rng.choice([" ", ", ", ". ", "; ", "\n", " (", ") "])
    return text, spans


def labelled_lines(count: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = random.Random(seed)
    return [labelled_line(rng) for _ in range(count)]
