"""DataFrame operators: journeys, credit, value, experiments."""
