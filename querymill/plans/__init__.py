"""End-to-end flows made of operators: preparation, training sets, evaluation."""
