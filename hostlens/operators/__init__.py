"""DataFrame-to-DataFrame operators: matching, component scores, evaluation."""
