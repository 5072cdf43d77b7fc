"""DataFrame operators: fan-out, training, voting, evaluation, versions."""
