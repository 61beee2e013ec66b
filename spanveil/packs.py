"""Bundled English packs of strong profanity: canonical forms, and evasions of them by one change."""

from __future__ import annotations

from spanveil.operators.rules import Entry, confusable_rule, define_pack, regex_rule

# Roots, the prefix and the endings that each family takes, and the edges of a word.
JOINERS = chr(0x200C) + chr(0x200D)
EDGE_BEFORE = rf"(?<![\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}{JOINERS}])"
EDGE_AFTER = rf"(?![\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}{JOINERS}])"
FAMILIES = {
    "fuck": ("mother", ["ing", "ed", "er", "ers", "s"]),
    "shit": ("bull", ["ting", "ted", "ter", "ters", "s", "ty"]),
    "bitch": ("", ["es", "ing", "ed", "y"]),
    "asshole": ("", ["s"]),
    "cunt": ("", ["s"]),
}
SUBSTITUTIONS = {
    "fuck": {"u": ["*"], "c": ["("]},
    "shit": {"s": ["$", "5"], "i": ["1", "!", "*"], "t": ["7"]},
    "bitch": {"i": ["1", "!", "*"], "t": ["7"]},
    "asshole": {"a": ["@"], "s": ["$", "5"], "o": ["0"]},
    "cunt": {"u": ["*"]},
}
IGNORED = [".", "-", chr(0x200B)]
WIDTH_LETTERS = "abcdefghiklmnorstuy"
CONFUSABLES = {"a": [chr(0x430)], "c": [chr(0x441)], "e": [chr(0x435)], "i": [chr(0x456)], "o": [chr(0x43E)], "s": [chr(0x455)]}


def _canonical():
    for root, (prefix, endings) in FAMILIES.items():
        before = f"(?:{prefix})?" if prefix else ""
        yield regex_rule(root, f"{EDGE_BEFORE}{before}(?<core>{root})(?:{'|'.join(endings)})?{EDGE_AFTER}", "giu", group="core", profile="canonical")


def _evasions():
    wide = {c: [chr(ord(c) + 0xFEE0)] for c in WIDTH_LETTERS}
    for root, (prefix, endings) in FAMILIES.items():
        forms = [Entry(p + root + e, target=root) for p in dict.fromkeys(["", prefix]) for e in ["", *endings]]
        yield confusable_rule(
            f"{root}-obfuscated", forms, CONFUSABLES, 1, 1, width_variants=wide, max_width_variants=1, substitutions=SUBSTITUTIONS[root], max_substitutions=1, ignored=IGNORED, max_ignored=1, max_changes=1
        )


def _manifest(id: str, name: str) -> dict:
    return {"schemaVersion": 1, "id": id, "version": "0.1.0", "name": name, "locales": ["en"], "registers": ["profane"], "categories": ["profanity"], "severity": ["strong"], "review": {"status": "maintained"}}


CANONICAL = define_pack(_manifest("en-strong-profanity", "English strong profanity"), _canonical())
OBFUSCATED = define_pack(_manifest("en-strong-profanity-obfuscated", "English strong profanity, evasions"), _evasions())
