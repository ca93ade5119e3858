"""Steps, their text form, and pipelines of them."""
