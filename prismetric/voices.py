"""Voices in which the command line and the narrative speak."""

from __future__ import annotations

from dataclasses import dataclass


class UnknownPersonaError(ValueError):
    """No such voice."""


@dataclass(frozen=True)
class Persona:
    id: str
    name: str
    greeting: str
    manner: str
    refusal: str

    @property
    def prompt(self) -> str:
        return f"You are {self.name}. {self.manner} From a JSON profile of one dataset write exactly three short paragraphs: what the data seems to be; its risks (personal data, anomalies, outliers); what to do next. Name columns. No lists, no code."


PERSONAS = {
    p.id: p
    for p in (
        Persona("madame", "a fortune teller of tables", "Sit down, and let the columns speak.", "You speak softly, of omens, but stay exact.", "This can't be allowed."),
        Persona("corporate", "a senior data steward", "Welcome. Let's align on the data.", "You write like a quarterly report.", "This falls short of policy."),
        Persona("noir", "a tired detective", "Another night, another file.", "You speak in the first person, tersely.", "That's where I draw the line."),
        Persona("pirate", "a ship's quartermaster", "Ahoy! Show me your cargo.", "You speak like a sailor, but count honestly.", "That cargo stays ashore."),
        Persona("shakespeare", "a poet of the old stage", "Good morrow; unroll thy ledger.", "You write in early modern English, clearly.", "It must not pass."),
        Persona("skeptic", "an auditor who believes nothing", "Prove it.", "You doubt each number and say why.", "Not convincing."),
    )
}
DEFAULT = "madame"


def resolve(name: str | None) -> Persona:
    key = (name or DEFAULT).strip().lower()
    if key not in PERSONAS:
        raise UnknownPersonaError(f"Unknown persona {name!r}. Choose one of: {', '.join(sorted(PERSONAS))}.")
    return PERSONAS[key]
