"""Settings, lenses, profiles and site modes: normalizing, and folding an ordered log of changes.

These are small documents per user. Users are many, so a log is grouped by user and folded per user; nothing is collected.
"""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What settings may be, and what older values have become.
APPEARANCES = ("scrawl", "bar", "blur", "whiteout", "mosaic")
COVERAGES = ("full", "tail", "middle", "inner", "vowel")
REVEALS = ("never", "hover", "click")
OLD_APPEARANCE = {"asterisk": "bar", "grawlix": "bar"}
OLD_REVEAL = {"focus": "click"}
MOST_CHARS, MOST_TERMS, MOST_TOTAL = 200, 500, 20_000
DEFAULTS = {"appearance": "scrawl", "coverage": "full", "reveal": "click"}
BUILT_IN = "english"


def look(value: dict | None) -> dict:
    value = value or {}
    appearance = OLD_APPEARANCE.get(value.get("appearance"), value.get("appearance"))
    reveal = OLD_REVEAL.get(value.get("reveal"), value.get("reveal"))
    pick = lambda v, allowed, name: v if v in allowed else DEFAULTS[name]
    return {"appearance": pick(appearance, APPEARANCES, "appearance"), "coverage": pick(value.get("coverage"), COVERAGES, "coverage"), "reveal": pick(reveal, REVEALS, "reveal")}


def terms(values, used_terms: int = 0, used_chars: int = 0) -> tuple[list[str], dict]:
    """First of each spelling within the budgets, and what became of the rest; skipped terms take no budget."""
    kept, seen, out = [], set(), {"added": 0, "duplicates": 0, "too_long": 0, "over_budget": 0}
    for v in values if isinstance(values, list) else []:
        t = v.strip() if isinstance(v, str) else ""
        if not t:
            continue
        if len(t) > MOST_CHARS:
            out["too_long"] += 1
        elif t.lower() in seen:
            out["duplicates"] += 1
        elif used_terms + len(kept) + 1 > MOST_TERMS or used_chars + sum(map(len, kept)) + len(t) > MOST_TOTAL:
            out["over_budget"] += 1
        else:
            seen.add(t.lower())
            kept.append(t)
            out["added"] += 1
    return kept, out


def sites(value) -> dict[str, str]:
    out = {}
    for host, mode in (value or {}).items():
        host = str(host).strip().lower()
        if host and mode in ("on", "off"):
            out[host] = mode
    return out


def normal(state: dict | None) -> dict:
    """A state with valid values only: the built-in lens first, first of each id, one term budget over all lenses, no lens that
    is missing, one profile at least, and an active profile that exists."""
    state = state if isinstance(state, dict) else {}
    lenses, n, chars = [{"id": BUILT_IN, "name": "English", "kind": "pack", "terms": []}], 0, 0
    for lens in state.get("lenses") or []:
        if not isinstance(lens, dict) or not lens.get("id") or any(x["id"] == lens["id"] for x in lenses):
            continue
        kept, _ = terms(lens.get("terms"), n, chars)
        n, chars = n + len(kept), chars + sum(map(len, kept))
        lenses.append({"id": lens["id"], "name": str(lens.get("name") or lens["id"]).strip(), "kind": "terms", "terms": kept})
    ids, profiles = [x["id"] for x in lenses], []
    for p in state.get("profiles") or []:
        if isinstance(p, dict) and p.get("id") and not any(x["id"] == p["id"] for x in profiles):
            wanted = p.get("lens_ids") or []
            profiles.append({"id": p["id"], "name": str(p.get("name") or p["id"]).strip(), "lens_ids": [i for i in ids if i in wanted], **look(p)})
    profiles = profiles or [{"id": "default", "name": "Default", "lens_ids": [BUILT_IN], **look(None)}]
    active = state.get("active_profile")
    active = active if any(p["id"] == active for p in profiles) else profiles[0]["id"]
    return {"paused": bool(state.get("paused")), "enabled": state.get("enabled", True) is not False, "site_modes": sites(state.get("site_modes")), "lenses": lenses, "profiles": profiles, "active_profile": active}


def active(state: dict) -> dict:
    return next((p for p in state["profiles"] if p["id"] == state["active_profile"]), state["profiles"][0])


def change(state: dict, intent: dict) -> dict:
    """``state`` after one intent; intents on what is not there change nothing."""
    s, kind = copy.deepcopy(state), intent.get("type")
    lens = next((x for x in s["lenses"] if x["id"] == intent.get("lens_id")), None)
    profile = next((x for x in s["profiles"] if x["id"] == intent.get("profile_id", s["active_profile"])), None)
    if kind == "set_paused":
        s["paused"] = bool(intent.get("value"))
    elif kind == "set_enabled":
        s["enabled"] = bool(intent.get("value"))
    elif kind == "set_site_mode":
        host = str(intent.get("host") or "").strip().lower()
        if host:
            s["site_modes"].pop(host, None)
            if intent.get("mode") in ("on", "off"):
                s["site_modes"][host] = intent["mode"]
    elif kind == "add_lens":
        s["lenses"].append({"id": intent.get("lens_id"), "name": intent.get("name"), "terms": intent.get("terms")})
    elif kind == "remove_lens" and lens and lens["id"] != BUILT_IN:
        s["lenses"].remove(lens)
    elif kind == "rename_lens" and lens and lens["id"] != BUILT_IN:
        lens["name"] = intent.get("name")
    elif kind == "set_terms" and lens and lens["id"] != BUILT_IN:
        lens["terms"] = intent.get("terms")
    elif kind == "merge_terms" and lens and lens["id"] != BUILT_IN:
        lens["terms"] = [*lens["terms"], *(intent.get("terms") or [])]
    elif kind == "add_profile":
        s["profiles"].append({"id": intent.get("profile_id"), "name": intent.get("name"), "lens_ids": intent.get("lens_ids")})
    elif kind == "remove_profile" and profile and len(s["profiles"]) > 1:
        s["profiles"].remove(profile)
    elif kind == "set_active_profile" and profile:
        s["active_profile"] = profile["id"]
    elif kind == "patch_profile" and profile:
        profile |= {k: v for k, v in (intent.get("patch") or {}).items() if k in ("name", "lens_ids", "appearance", "coverage", "reveal")}
    elif kind == "add_selected_term":
        own = active(s)
        target = next((x for x in s["lenses"] if x["id"] in own["lens_ids"] and x["kind"] == "terms"), None)
        if target is None:
            target = next((x for x in s["lenses"] if x["id"] == "quick-terms"), None)
            if target is None:
                target = {"id": "quick-terms", "name": "Quick terms", "kind": "terms", "terms": []}
                s["lenses"].append(target)
            own["lens_ids"] = [*own["lens_ids"], "quick-terms"]
        target["terms"] = [*target["terms"], " ".join(str(intent.get("term") or "").split())]
    return normal(s)


def fold_log(log: DataFrame, user: str = "user_id", order: str = "seq", intent: str = "intent") -> DataFrame:
    """(user, state JSON) after each user's intents (JSON) in order; one task holds one user's log at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = normal(None)
        for raw in pdf.sort_values(order)[intent]:
            state = change(state, json.loads(raw))
        return pd.DataFrame({user: [pdf[user].iloc[0]], "state": [json.dumps(state, sort_keys=True)]})

    kind = log.schema[user].dataType.simpleString()
    return log.groupBy(user).applyInPandas(run, f"{user} {kind}, state string")


def profile_terms(state: dict) -> list[str]:
    """The terms of the active profile's lenses, in the lenses' order, as one budgeted list."""
    wanted = active(state)["lens_ids"]
    return terms([t for x in state["lenses"] if x["id"] in wanted for t in x["terms"]])[0]


def rules_of(state: dict) -> list:
    """The rules of the active profile: the English pack if its lens is on, and one rule of its terms."""
    from spanveil import packs
    from spanveil.operators.rules import rules_from_packs, term_rule

    rules = rules_from_packs(packs.CANONICAL) if BUILT_IN in active(state)["lens_ids"] else []
    own = profile_terms(state)
    return rules + ([term_rule("custom", own)] if own else [])


def usage(lenses: DataFrame) -> DataFrame:
    """(user_id, terms, chars) over each user's lenses (user_id, terms)."""
    return lenses.select("user_id", F.explode("terms").alias("t")).groupBy("user_id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.length("t")).alias("chars"))
