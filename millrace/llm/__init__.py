"""Training-data operators: ten stages that prepare a text corpus at cluster scale."""
