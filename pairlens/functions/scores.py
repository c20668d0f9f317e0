"""The three preference-score formulas.

Operand order is part of the contract: stored derived columns must equal the
recomputed ones bit for bit, so nothing here may be rearranged algebraically.

Formulas are SQL text: a score table has dozens of them, and one parsed
expression costs far less to set up than a tree of Python column calls.
"""

from __future__ import annotations

from pairlens.vocabulary import FORMULAS, require_known, total_columns


def score_formula(
    formula: str,
    adapter_chosen: str,
    base_chosen: str,
    chosen_length: str,
    adapter_rejected: str,
    base_rejected: str,
    rejected_length: str,
) -> str:
    """SQL text of a formula over the given SQL operands."""
    require_known("formula", formula, FORMULAS)
    chosen_shift = f"({adapter_chosen} - {base_chosen})"
    rejected_shift = f"({adapter_rejected} - {base_rejected})"
    n_chosen = f"CAST({chosen_length} AS DOUBLE)"
    n_rejected = f"CAST({rejected_length} AS DOUBLE)"
    if formula == "sum":
        return f"({chosen_shift} - {rejected_shift})"
    if formula == "lls":
        return f"(({chosen_shift} - {rejected_shift}) / ({n_chosen} + {n_rejected}))"
    return f"({chosen_shift} / {n_chosen} - {rejected_shift} / {n_rejected})"


def adapter_score(formula: str, adapter: str) -> str:
    """Formula over the standard column names of a score table."""
    chosen, rejected = total_columns(adapter)
    return score_formula(
        formula,
        f"`{chosen}`",
        "base_chosen_logprob",
        "chosen_response_tokens",
        f"`{rejected}`",
        "base_rejected_logprob",
        "rejected_response_tokens",
    )
