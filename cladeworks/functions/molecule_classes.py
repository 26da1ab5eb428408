"""The class graph of the molecule kernel."""

from __future__ import annotations

from ..operators.rules import ClassNode, RuleSet

#: Class id, name, parents, priority. Ids and priorities decide ties, so they are kept as published.
CLASSES = (
    ("0001", "Chemical entity", (), 0),
    ("0100", "Organic compound", ("0001",), 10),
    ("0110", "Nitrogen-containing compound", ("0100",), 20),
    ("0120", "Oxygen-containing compound", ("0100",), 20),
    ("0130", "Sulfur-containing compound", ("0100",), 20),
    ("0140", "Phosphorus-containing compound", ("0100",), 20),
    ("0150", "Boron-containing compound", ("0100",), 20),
    ("0200", "Amine", ("0110",), 40),
    ("0201", "Primary amine", ("0200",), 70),
    ("0202", "Secondary amine", ("0200",), 70),
    ("0203", "Tertiary amine", ("0200",), 65),
    ("0204", "Aromatic amine", ("0200",), 90),
    ("0300", "Carboxylic acid", ("0120",), 80),
    ("0310", "Alcohol", ("0120",), 55),
    ("0311", "Phenol", ("0120",), 80),
    ("0320", "Aldehyde", ("0120",), 75),
    ("0321", "Ketone", ("0120",), 70),
    ("0400", "Organohalogen", ("0100",), 45),
    ("0401", "Organofluorine", ("0400",), 65),
    ("0402", "Organochlorine", ("0400",), 65),
    ("0403", "Organobromine", ("0400",), 65),
    ("0404", "Organoiodine", ("0400",), 65),
    ("0500", "Heterocyclic compound", ("0100",), 55),
    ("0501", "Heteroaromatic compound", ("0500",), 75),
    ("0502", "Pyridine", ("0501",), 100),
    ("0600", "Boronic acid", ("0120", "0150"), 100),
    ("0601", "Boronate ester", ("0120", "0150"), 100),
    ("0700", "Multifunctional compound", ("0100",), 5),
    ("0800", "Unresolved organic compound", ("0100",), -100),
)

#: The graph, with no SQL rules: the kernel gives the direct classes.
MOLECULES = RuleSet(tuple(ClassNode(i, n, p) for i, n, _, p in CLASSES), tuple((p, i) for i, _, ps, _ in CLASSES for p in ps), (), root="0001", gate="true", multiple="0700", unresolved="0800")
