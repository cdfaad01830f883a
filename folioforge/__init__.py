"""Document analytics on Spark: conversion, layout, evaluation and text operators."""

__version__ = "0.1.0"
