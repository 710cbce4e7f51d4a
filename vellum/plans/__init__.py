"""From query text to a DataFrame: dialect, intermediate form, compiler."""
