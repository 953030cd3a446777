"""DataFrame -> DataFrame operators (relational helpers, quality, roll-ups, dimensions,
panels and gap filling, calendar baselines, event windows, forecasting, evaluation, charts)."""
