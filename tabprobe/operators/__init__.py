"""DataFrame operators: ranks, aggregates, injections, answers, grading, reports."""
