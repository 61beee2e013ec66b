"""Rules, their factories and packs. Rules are plain values that pickle; matchers are prepared from them once a process."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

import regex

from spanveil.functions.patterns import compiled
from spanveil.functions.unicode import collation_key, fold, graphemes, normal, trim

PRESETS = ("full", "tail", "middle", "inner")
BOUNDARIES = ("word", "unicode-word", "substring")
FORMS = ("none", "NFC", "NFD", "NFKC", "NFKD")
_LETTER = regex.compile(r"\p{L}\p{M}*\Z")

Coverage = str | Callable[[dict], Iterable[tuple[int, int]]] | None


@dataclass(frozen=True)
class Rule:
    """``kind`` names the matcher and ``spec`` holds its prepared settings."""

    id: str
    kind: str
    spec: dict = field(hash=False)
    profile: str | None = None
    coverage: Coverage = None
    pack_id: str | None = None

    @property
    def name(self) -> str:
        return f"{self.pack_id}:{self.id}" if self.pack_id else self.id


@dataclass(frozen=True)
class LocaleWord:
    """A boundary at the edges of word-like segments of the given locales."""

    locales: tuple[str, ...]


def _checked(boundary, normalization: str, coverage: Coverage) -> None:
    if not (isinstance(boundary, LocaleWord) or boundary in BOUNDARIES):
        raise ValueError(f"unknown boundary {boundary!r}")
    if normalization not in FORMS:
        raise ValueError(f"unknown normalization {normalization!r}")
    if isinstance(coverage, str) and coverage not in PRESETS:
        raise ValueError(f"unknown coverage {coverage!r}")


def regex_rule(id: str, pattern: str, flags: str = "u", group: str | None = None, profile: str | None = None, coverage: Coverage = None) -> Rule:
    scanner = compiled(pattern, flags, id)
    if group is not None and group not in scanner.groupindex:
        raise ValueError(f'Rule "{id}" targets group "{group}", which its pattern does not have.')
    return Rule(id, "regex", {"pattern": pattern, "flags": flags, "group": group}, profile, coverage)


def matcher_rule(id: str, find: Callable[[str], Iterable[tuple]], profile: str | None = None, coverage: Coverage = None) -> Rule:
    """``find`` yields (start, end) or (start, end, target_start, target_end) in code points."""
    return Rule(id, "matcher", {"find": find}, profile, coverage)


def prepared_terms(terms: Iterable[str], normalization: str) -> list[str]:
    """Trimmed, normalized, without blanks and repeats, longest in UTF-16 first."""
    kept = dict.fromkeys(t for t in (normal(trim(t), normalization) for t in terms) if t)
    if not kept:
        raise ValueError("A rule needs at least one non-empty term.")
    return sorted(kept, key=lambda t: -len(t.encode("utf-16-le")))


def term_rule(id: str, terms: Iterable[str], case_sensitive: bool = False, boundary="word", normalization: str = "NFC", profile: str = "canonical", coverage: Coverage = None) -> Rule:
    _checked(boundary, normalization, coverage)
    return Rule(id, "terms", {"terms": prepared_terms(terms, normalization), "case_sensitive": case_sensitive, "boundary": boundary, "normalization": normalization}, profile, coverage)


def transformed_rule(id: str, terms: Iterable[str], transform: Callable[[str], str], boundary="word", normalization: str = "NFC", casing: str | tuple[str, str] = "unicode-insensitive", profile: str = "canonical", coverage: Coverage = None) -> Rule:
    """Terms and text both pass, grapheme by grapheme, through ``transform`` and the casing policy: ``sensitive``,
    ``unicode-insensitive`` or ("locale-insensitive", locale)."""
    _checked(boundary, normalization, coverage)
    if casing not in ("sensitive", "unicode-insensitive") and not (isinstance(casing, tuple) and casing[0] == "locale-insensitive"):
        raise ValueError(f"unknown casing {casing!r}")
    return Rule(id, "transformed", {"terms": prepared_terms(terms, normalization), "transform": transform, "casing": casing, "boundary": boundary, "normalization": normalization}, profile, coverage)


def _single(value: str, what: str, form: str) -> str:
    value = normal(value, form)
    if len(graphemes(value)) != 1:
        raise ValueError(f"{what} {value!r} must be exactly one extended grapheme.")
    return value


def _budget(name: str, value: int | None, wanted: bool) -> int:
    if wanted and value is None:
        raise ValueError(f"an explicit {name} is required when that class of changes is configured.")
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ValueError(f"{name} must be a non-negative integer.")
    return value or 0


@dataclass(frozen=True)
class Changes:
    """Which graphemes stand for which, by class, and how many changes of each class a candidate may have."""

    sources: Mapping[str, str]  # source grapheme -> canonical
    classes: Mapping[str, str]  # source grapheme -> substitution, width or confusable
    ignored: frozenset
    limits: Mapping[str, int]  # by class, and ignored, repetition, all


def fullwidth_to_ascii(value: str) -> str | None:
    return chr(ord(value) - 0xFEE0) if len(value) == 1 and 0xFF01 <= ord(value) <= 0xFF5E else None


def _mapped(tables: Mapping[str, Mapping[str, Iterable[str]]], form: str) -> tuple[dict[str, str], dict[str, str]]:
    sources: dict[str, str] = {}
    classes: dict[str, str] = {}
    for name, mapping in tables.items():
        for key, values in mapping.items():
            canonical = _single(key, f"{name} key", form)
            if name == "width" and not (len(canonical) == 1 and "\x21" <= canonical <= "\x7e"):
                raise ValueError(f"width key {key!r} must be one printable ASCII grapheme.")
            for value in values:
                source = _single(value, f"{name} value", form)
                if source == canonical:
                    raise ValueError(f"{name} value {value!r} maps to itself.")
                if name == "width" and fullwidth_to_ascii(source) != canonical:
                    raise ValueError(f"width value {value!r} must be the fullwidth form of {key!r}.")
                if name == "confusable" and fullwidth_to_ascii(source) is not None:
                    raise ValueError(f"confusable value {value!r} is a fullwidth form and belongs in the width table.")
                if name == "confusable" and normal(source, "NFKC") == normal(canonical, "NFKC"):
                    raise ValueError(f"confusable value {value!r} is compatibility-equivalent to {key!r}.")
                if classes.get(source, name) != name:
                    raise ValueError(f"{name} value {value!r} cannot also be a {classes[source]}.")
                if sources.get(source, canonical) != canonical:
                    raise ValueError(f"{name} value {value!r} maps to both {sources[source]!r} and {canonical!r}.")
                sources[source], classes[source] = canonical, name
    return sources, classes


def _changes(form: str, tables: dict, ignored: Iterable[str], limits: dict[str, int | None], repeated: bool, max_changes: int | None) -> Changes:
    sources, classes = _mapped(tables, form)
    skipped = frozenset(_single(v, "ignored value", form) for v in ignored)
    if both := skipped & set(sources):
        raise ValueError(f"{sorted(both)} cannot be both ignored and substituted.")
    used = set(classes.values())
    got = {k: _budget(f"max_{k}", limits.get(k), k in used) for k in ("substitution", "width", "confusable")}
    got["ignored"] = _budget("max_ignored", limits.get("ignored"), bool(skipped))
    got["repetition"] = _budget("max_repetitions", limits.get("repetition"), repeated)
    several = len(used) + bool(skipped) + repeated > 1
    if several and max_changes is None:
        raise ValueError("an explicit max_changes is required when classes of changes are combined.")
    single = got["repetition"] if repeated else max(got["substitution"], got["ignored"])
    got["all"] = _budget("max_changes", max_changes if max_changes is not None else single, True)
    return Changes(sources, classes, skipped, got)


@dataclass(frozen=True)
class Entry:
    """A term with its target: a unique substring, or a half-open range of grapheme indexes; the whole term if neither."""

    term: str
    target: str | None = None
    target_range: tuple[int, int] | None = None


@dataclass(frozen=True)
class Prepared:
    """A term's graphemes, the grapheme range of its target and its runs of one letter."""

    units: tuple[str, ...]
    target: tuple[int, int]
    runs: tuple[tuple[str, int, int, bool], ...]  # value, first index, count, repeatable


def _prepare(entry: Entry | str, form: str, case_sensitive: bool) -> Prepared | None:
    entry = Entry(entry) if isinstance(entry, str) else entry
    term = normal(trim(entry.term), form)
    if not term:
        return None
    ranges = graphemes(term)
    units = tuple(term[a:b] for a, b in ranges)
    if entry.target is not None and entry.target_range is not None:
        raise ValueError(f"term {term!r} has two targets.")
    if entry.target_range is not None:
        a, b = entry.target_range
        if not 0 <= a < b <= len(units):
            raise ValueError(f"the target range of {term!r} is out of bounds.")
        target = (a, b)
    elif entry.target is not None:
        wanted = normal(trim(entry.target), form)
        at = term.find(wanted)
        if not wanted or at < 0:
            raise ValueError(f"target {entry.target!r} is not in {term!r}.")
        if term.find(wanted, at + 1) >= 0:
            raise ValueError(f"target {entry.target!r} is in {term!r} more than once.")
        starts, ends = {a: i for i, (a, _) in enumerate(ranges)}, {b: i + 1 for i, (_, b) in enumerate(ranges)}
        if at not in starts or at + len(wanted) not in ends:
            raise ValueError(f"target {entry.target!r} splits a grapheme of {term!r}.")
        target = (starts[at], ends[at + len(wanted)])
    else:
        target = (0, len(units))
    key = (lambda u: u) if case_sensitive else str.lower
    runs, i = [], 0
    while i < len(units):
        j = i + 1
        while j < len(units) and key(units[j]) == key(units[i]):
            j += 1
        runs.append((units[i], i, j - i, _LETTER.match(units[i]) is not None))
        i = j
    return Prepared(units, target, tuple(runs))


def _entries(entries: Iterable[Entry | str], form: str, case_sensitive: bool) -> list[Prepared]:
    found: dict[tuple[str, ...], Prepared] = {}
    for entry in entries:
        p = _prepare(entry, form, case_sensitive)
        if p is None:
            continue
        if p.units in found and found[p.units].target != p.target:
            raise ValueError(f"term {''.join(p.units)!r} was declared with conflicting targets.")
        found.setdefault(p.units, p)
    if not found:
        raise ValueError("A rule needs at least one non-empty term.")
    return sorted(found.values(), key=lambda p: (-len(p.units), -len("".join(p.units).encode("utf-16-le"))))


def _family(id, entries, kind, tables, ignored, limits, repeated, max_changes, case_sensitive, boundary, normalization, profile, coverage) -> Rule:
    _checked(boundary, normalization, coverage)
    spec = {
        "entries": _entries(entries, normalization, case_sensitive),
        "changes": _changes(normalization, tables, ignored, limits, repeated, max_changes),
        "case_sensitive": case_sensitive,
        "boundary": boundary,
        "normalization": normalization,
    }
    return Rule(id, kind, spec, profile, coverage)


def obfuscated_rule(id: str, terms: Iterable[str], substitutions: Mapping = {}, ignored: Iterable[str] = (), max_substitutions=None, max_ignored=None, max_changes=None, case_sensitive=False, boundary="word", normalization="NFC", profile="obfuscated", coverage: Coverage = None) -> Rule:
    """Every occurrence, overlapping ones too, that needs at least one change and no more than its budgets."""
    limits = {"substitution": max_substitutions, "ignored": max_ignored}
    return _family(id, list(terms), "obfuscated", {"substitution": substitutions}, ignored, limits, False, max_changes, case_sensitive, boundary, normalization, profile, coverage)


def targeted_rule(id: str, entries: Iterable[Entry | str], **options) -> Rule:
    """As ``obfuscated_rule``, each term with its own target, longer terms first."""
    return replace(obfuscated_rule(id, entries, **options), kind="targeted")


def repeated_rule(id: str, entries: Iterable[Entry | str], max_repetitions: int, substitutions: Mapping = {}, ignored: Iterable[str] = (), max_substitutions=None, max_ignored=None, max_changes=None, case_sensitive=False, boundary="word", normalization="NFC", profile="obfuscated", coverage: Coverage = None) -> Rule:
    """Leftmost occurrences that do not overlap; letters may repeat beyond the term's own runs."""
    limits = {"substitution": max_substitutions, "ignored": max_ignored, "repetition": max_repetitions}
    return _family(id, entries, "repeated", {"substitution": substitutions}, ignored, limits, True, max_changes, case_sensitive, boundary, normalization, profile, coverage)


def width_rule(id: str, entries: Iterable[Entry | str], width_variants: Mapping, max_width_variants: int, max_repetitions: int, **options) -> Rule:
    """As ``repeated_rule``, with fullwidth forms as a class of their own."""
    return confusable_rule(id, entries, {}, None, max_repetitions, width_variants=width_variants, max_width_variants=max_width_variants, kind="width", **options)


def confusable_rule(id: str, entries: Iterable[Entry | str], confusables: Mapping, max_confusables: int | None, max_repetitions: int, width_variants: Mapping = {}, max_width_variants=None, substitutions: Mapping = {}, ignored: Iterable[str] = (), max_substitutions=None, max_ignored=None, max_changes=None, case_sensitive=False, boundary="word", normalization="NFC", profile="obfuscated", coverage: Coverage = None, kind="confusable") -> Rule:
    """As ``width_rule``, with lookalikes of other scripts as a third class."""
    tables = {"substitution": substitutions, "width": width_variants, "confusable": confusables}
    limits = {"substitution": max_substitutions, "width": max_width_variants, "confusable": max_confusables, "ignored": max_ignored, "repetition": max_repetitions}
    return _family(id, entries, kind, tables, ignored, limits, True, max_changes, case_sensitive, boundary, normalization, profile, coverage)


@dataclass(frozen=True)
class Pack:
    id: str
    rules: tuple[Rule, ...]
    locale: str | None = None
    manifest: Mapping | None = field(default=None, hash=False)


def rules_from_packs(*packs: Pack) -> list[Rule]:
    """The packs' rules in order, each stamped with its pack."""
    return [replace(r, pack_id=p.id) for p in packs for r in p.rules]


def canonical_locale(tag: str) -> str:
    """A language tag in its usual casing: language lower, script title, region upper."""
    parts = tag.strip().replace("_", "-").split("-")
    if not regex.fullmatch(r"[A-Za-z]{2,8}", parts[0]) or any(not regex.fullmatch(r"[A-Za-z0-9]{1,8}", p) for p in parts[1:]):
        raise ValueError(f"{tag!r} is not a language tag.")
    out = [parts[0].lower()]
    for p in parts[1:]:
        single = any(len(x) == 1 for x in out[1:])
        out.append(p.title() if len(p) == 4 and p.isalpha() and not single else p.upper() if len(p) == 2 and not single else p.lower())
    return "-".join(out)


def define_pack(manifest: Mapping, rules: Iterable[Rule]) -> Pack:
    """A pack whose manifest is checked and put in canonical form: schema version 1, id, version, name, locales, unique provenance."""
    clean = dict(manifest)
    if clean.get("schemaVersion") != 1:
        raise ValueError("schemaVersion must be 1.")
    for name in ("id", "version", "name"):
        if not isinstance(clean.get(name), str) or not clean[name].strip():
            raise ValueError(f"{name} must be a non-empty string.")
        clean[name] = clean[name].strip()
    clean["locales"] = list(dict.fromkeys(canonical_locale(x) for x in clean.get("locales") or ()))
    if not clean["locales"]:
        raise ValueError("locales must not be empty.")
    for name in ("dialects", "regions", "registers", "categories", "severity", "limitations"):
        if clean.get(name) is not None:
            clean[name] = list(dict.fromkeys(v.strip() for v in clean[name] if v.strip()))
    status = (clean.get("review") or {}).get("status")
    if not status:
        raise ValueError("review.status is required.")
    ids = [p["id"] for p in clean.get("provenance") or ()]
    if len(ids) != len(set(ids)):
        raise ValueError("provenance ids must be unique.")
    rules = tuple(rules)
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rule ids must be unique within a pack.")
    return Pack(clean["id"], rules, clean["locales"][0], clean)


def rank_of(rules: list[Rule]) -> list[int]:
    """Place of each rule in the order of pack id, then rule id; equal ids share a place."""
    keys = [(collation_key(r.pack_id or ""), collation_key(r.id)) for r in rules]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [place[k] for k in keys]


def folded(value: str, case_sensitive: bool) -> str:
    return value if case_sensitive else fold(value)
