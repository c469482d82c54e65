"""Vector expressions and dense row operators."""
