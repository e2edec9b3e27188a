"""Operations of a training-data pipeline over document tables, one module for each operator."""
