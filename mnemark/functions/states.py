"""US states by name and code, for place filters."""

from __future__ import annotations

# States and the District of Columbia.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
_BY_CODE = {c: n for n, c in STATES.items()}


def state(text: str | None) -> tuple[str, str] | None:
    """(code, name) of a state given by either, in any case."""
    t = (text or "").strip()
    name = t.lower() if t.lower() in STATES else _BY_CODE.get(t.upper())
    return (STATES[name], " ".join(w if w == "of" else w.capitalize() for w in name.split())) if name else None


def place_patterns(text: str) -> list[str]:
    """LIKE patterns of a place filter: a state is found by its name and by its code after a comma."""
    s = state(text)
    return [f"%{s[1]}%", f"%, {s[0]}"] if s else [f"%{text}%"]
